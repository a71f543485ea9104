"""Token counts with a whole-token shortcut.

Offline, on the driver, every string of the vocabulary is put through the tokenizer: those that come
out as exactly one token (one pre-token, wholly merged) are the proven whole tokens. Executors cut
texts into pre-tokens, count the proven ones directly and leave merging to the library for the rest,
each distinct pre-token once.

The shortcut is used on code points whose letter, number and white-space classes are proven to be the
same in Python and in the library (tests/llm/test_texts.py goes through all of them). Any other
text, and any tokenizer that is not plain byte-level BPE, is encoded by the library as a whole.

Cases: null or empty text has 0 tokens and 0 bytes; repeated rows and null ids are kept as they are;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, released, whole_text

OVER_LIMIT = 1024
#: Pre-tokens that a worker remembers before it starts anew; bounds its memory, not its work.
MEMO_ENTRIES = 400_000

#: The published pre-token pattern of byte-level BPE.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points below this are cut by the standard library's faster engine, with classes built from unicodedata.
LOW_END = 0x530
#: Ranges in which the classes are proven equal; texts with any other code point go to the library whole.
PROVEN_RANGES = ((0x0, 0x557), (0x5D0, 0x5EA), (0x620, 0x6D3), (0x900, 0x963), (0x1E00, 0x1EFF), (0x2000, 0x2070), (0x20A0, 0x20BF), (0x2190, 0x21FF), (0x3000, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E), (0x1F300, 0x1F64F))


def _class(test) -> str:
    """A character class of the code points under LOW_END that meet test."""
    found = [c for c in range(LOW_END) if test(chr(c))]
    out, i = [], 0
    while i < len(found):
        j = i
        while j + 1 < len(found) and found[j + 1] == found[j] + 1:
            j += 1
        out.append(f"\\u{found[i]:04x}-\\u{found[j]:04x}")
        i = j + 1
    return "".join(out)


def low_pattern() -> re.Pattern:
    letter = _class(lambda c: unicodedata.category(c)[0] == "L")
    number = _class(lambda c: unicodedata.category(c)[0] == "N")
    space = "\\t-\\r \\x85\\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: bytes that print stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_plain_byte_level(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    return spec["model"]["type"] == "BPE" and not spec.get("normalizer") and not spec["model"].get("dropout") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and bool(pre.get("use_regex", True)) and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))


def prove_whole_tokens(spec_text: str) -> frozenset[str]:
    """The vocabulary strings that the tokenizer itself encodes, alone, as exactly one token. At most the vocabulary's size."""
    from tokenizers import Tokenizer

    spec = json.loads(spec_text)
    added = {t["content"] for t in spec.get("added_tokens", [])}
    back = byte_chars()
    strings = []
    for piece in spec["model"]["vocab"]:
        if piece in added:
            continue
        try:
            strings.append(bytes(back[c] for c in piece).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue  # not a whole string of characters, so never a whole pre-token
    tokenizer = _load(spec_text)
    assert isinstance(tokenizer, Tokenizer)
    encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded) if len(e.ids) == 1)


def _load(spec_text: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec_text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Counts(dict):
    """Pre-token to number of tokens; the library merges what is not there."""

    def __init__(self, whole: frozenset[str], tokenizer):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merge = whole, tokenizer.model.tokenize
        self.table = {b: c for c, b in byte_chars().items()}

    def __missing__(self, pre_token: str) -> int:
        n = self[pre_token] = len(self.merge(pre_token.encode().decode("latin-1").translate(self.table)))
        return n

    def trim(self) -> None:
        if len(self) > len(self.whole) + MEMO_ENTRIES:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))


class WholeTokenCounter:
    def __init__(self, spec_text: str, whole: frozenset[str] | None = None):
        spec = json.loads(spec_text)
        self.tokenizer = _load(spec_text)
        self.plain = is_plain_byte_level(spec)
        if not self.plain:
            return
        self.counts = _Counts(prove_whole_tokens(spec_text) if whole is None else whole, self.tokenizer)
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.low, self.any = low_pattern(), regex.compile(BYTE_LEVEL_PATTERN)
        self.above_low = re.compile(f"[^\\u0000-\\u{LOW_END - 1:04x}]")
        self.unproven = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in PROVEN_RANGES) + "]")

    def count(self, texts: list[str]) -> list[int]:
        if not self.plain:
            return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for text in texts:
            if self.unproven.search(text):
                out.append(len(self.tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            parts, n = [text], 0
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                n = len(parts) - 1
            cut = (self.any if self.above_low.search(text) else self.low).findall
            for part in parts:
                n += sum(map(self.counts.__getitem__, cut(part)))
            out.append(n)
            self.counts.trim()
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, over_limit: int = OVER_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. The tokenizer file is read on the driver and broadcast: its size does not grow with the data."""
    spark = docs.sparkSession
    model = tokenizer_path.endswith(".model")
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    whole = None if model or not is_plain_byte_level(json.loads(raw)) else prove_whole_tokens(raw.decode())
    shared = spark.sparkContext.broadcast((raw, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=shared.value[0])
            count = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        else:
            count = WholeTokenCounter(shared.value[0].decode(), shared.value[1]).count
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id"), whole_text().alias("text"), F.octet_length(whole_text()).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(released(run), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(over_limit))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
