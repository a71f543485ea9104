"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file's protobuf is parsed here; normaliser, white-space marker, vocabulary scores and byte fallback
are rebuilt as a tokenizers model: unigram from the scores, or BPE with merges ranked by the scores. If no piece
holds the marker after another character, no merge can cross the start of a word, so a text's words are
encoded once each, in batches that the library runs multithreaded; other texts are encoded whole. All that the backend
gives is held against the SentencePiece library: parity tells for each text whether the two agree, and where they do not the
text has the latter's ids. Every text is decoded again and compared.

A Python worker keeps one encoder for all of its tasks, and of the words' ids no more than MEMO_BYTES.

Cases: null and empty texts have no ids and decode to the empty text. A text that holds the marker itself
cannot be told from one with spaces there, as in SentencePiece; it decodes to spaces. Repeated rows and
null ids are kept, extra columns are ignored by encode. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, released, whole_text

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: What a worker keeps of words and their ids at most, and what an entry takes besides the bytes of both.
MEMO_BYTES, ENTRY_BYTES, WORDS_PER_TEXT = 32 << 20, 180, 256
#: Characters of a text that are cut into words at once; bounds the lists that a very long text takes.
PIECE = 1 << 19
#: Threads of the library in each worker; left alone it starts one for every core of the machine, each with memory of its own.
THREADS = 2


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protobuf message."""
    i, n = 0, len(raw)

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[i]
            i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, i

    while i < n:
        key, i = varint(i)
        wire = key & 7
        if wire == 0:
            value, i = varint(i)
        elif wire == 2:
            size, i = varint(i)
            value, i = raw[i : i + size], i + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, i = raw[i : i + size], i + size
        else:
            raise ValueError(f"wire type {wire} is not used in model files")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def parse_model(raw: bytes) -> Model:
    """Fields of the published model protobuf: pieces (1), trainer (2) and normaliser (3)."""
    m = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            m.pieces.append(piece[1].decode("utf-8"))
            m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            m.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(_fields(value))
            m.model_type, m.byte_fallback, m.suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.remove_extra, m.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    return m


def build_tokenizer(m: Model):
    """The tokenizers model over normalised text; words are cut off by its pre-tokenizer."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ids = {p: i for i, p in enumerate(m.pieces)}
    unknown = m.kinds.index(UNKNOWN)
    if m.model_type == UNIGRAM:
        model = models.Unigram(list(zip(m.pieces, m.scores)), unknown, m.byte_fallback)
    elif m.model_type == BPE:
        usable = {p for p, k in zip(m.pieces, m.kinds) if k in (NORMAL, USER_DEFINED)}
        ranked = sorted((i for i, p in enumerate(m.pieces) if p in usable and len(p) > 1), key=lambda i: (-m.scores[i], i))
        merges = [(p[:k], p[k:]) for p in (m.pieces[i] for i in ranked) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        model = models.BPE(ids, merges, unk_token=m.pieces[unknown], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.model_type} is neither unigram nor BPE")
    tokenizer = Tokenizer(model)
    if splits_at_words(m):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    return tokenizer


def build_normalizer(m: Model):
    """Text to normalised text, as the normaliser's fields say."""
    from tokenizers import normalizers

    mapped = normalizers.Precompiled(m.charsmap) if m.charsmap else None

    def normal(text: str) -> str:
        if mapped is not None:
            text = mapped.normalize_str(text)
        if m.remove_extra:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if not text:
            return ""
        if m.dummy_prefix:
            text = text + " " if m.suffix else " " + text
        return text.replace(" ", MARK) if m.escape else text

    return normal


def splits_at_words(m: Model) -> bool:
    """Proven from the vocabulary: no piece has the marker after another character, so none crosses the start of a word."""
    crossing = re.compile(f"[^{MARK}]{MARK}")
    return m.escape and not m.suffix and not any(crossing.search(p) for p, k in zip(m.pieces, m.kinds) if k in (NORMAL, USER_DEFINED)) and USER_DEFINED not in m.kinds


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class SentencePieces:
    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = parse_model(raw)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.tokenizer, self.normal = build_tokenizer(self.model), build_normalizer(self.model)
        self.by_word = splits_at_words(self.model) and self.model.dummy_prefix and not self.model.remove_extra and not self.model.charsmap
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.start = re.compile(f"(?<=[^{MARK}]){MARK}")
        self.memo: dict[str, bytes] = {}  # packed: a list of numbers takes several times as much
        self.held, self.differing = 0, set()
        self.bytes = []
        for p, k in zip(self.model.pieces, self.model.kinds):
            self.bytes.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode())

        self.sizes = np.array(list(map(len, self.bytes)))

    def _keep(self, word: str, ids: list[int]) -> None:
        self.memo[word] = packed = _packed(ids)
        self.held += ENTRY_BYTES + len(word) + len(packed)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, many words to a text; every text is held against the library."""
        # markers alone, as at the end of a text, would join the word after them
        alone = [[w] for w in words if not w.strip(MARK)]
        words = [w for w in words if w.strip(MARK)]
        texts = [words[i : i + WORDS_PER_TEXT] for i in range(0, len(words), WORDS_PER_TEXT)] + alone
        joined = ["".join(t) for t in texts]
        backend = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        library = [self._library(j) for j in joined]
        for own, found, true in zip(texts, backend, library):
            got = found.ids
            if got != true:
                for w in own:
                    right = self._library(w)
                    if self.tokenizer.encode(w, add_special_tokens=False).ids != right:
                        self.differing.add(w)
                    self._keep(w, right)
                continue
            # tokens spell their words byte for byte, so lengths tell where a word's tokens end
            spelled = np.cumsum([len(w.replace(MARK, " ").encode()) for w in own])
            edges = [0, *(np.searchsorted(np.cumsum(self.sizes[got]), spelled) + 1).tolist()]
            for w, a, b in zip(own, edges, edges[1:]):
                self._keep(w, got[a:b])

    def _library(self, normal: str) -> list[int]:
        """The library's ids of a normalised text; it adds the first marker itself, but not to an empty text."""
        return [self.library.piece_to_id(MARK)] if normal == MARK else self.library.encode(normal[1:].replace(MARK, " "))

    def _pieces(self, normal: str) -> Iterator[str]:
        """A normalised text in pieces of about PIECE characters that end where a word begins."""
        at = 0
        while len(normal) - at > PIECE and (m := self.start.search(normal, at + PIECE)):
            yield normal[at : m.start()]
            at = m.start()
        yield normal[at:] if at else normal

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether backend and library agree on it."""
        normal = [self.normal(t) for t in texts]
        if not self.by_word:
            backend = [e.ids for e in self.tokenizer.encode_batch_fast(normal, add_special_tokens=False)]
            library = self.library.encode(texts, num_threads=1)
            same = [a == b for a, b in zip(backend, library)]
            return [np.array(a if s else b, np.int32) for a, b, s in zip(backend, library, same)], same
        out, same, short = [b""] * len(texts), [True] * len(texts), []
        for i, t in enumerate(normal):
            if len(t) <= PIECE:
                short.append(i)
                continue
            found = [(ids[0], equal[0]) for ids, equal in (self._by_word([piece]) for piece in self._pieces(t))]
            out[i], same[i] = b"".join(ids for ids, _ in found), all(equal for _, equal in found)
        for i, ids, equal in zip(short, *self._by_word([normal[i] for i in short])):
            out[i], same[i] = ids, equal
        return [np.frombuffer(ids, np.int32) for ids in out], same

    def _by_word(self, normal: list[str]) -> tuple[list[bytes], list[bool]]:
        cuts = [self.cut(t) for t in normal]
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.differing.clear()
            self.held = 0
        # a word without a marker before it would join its neighbour; with the dummy prefix there is none
        self._learn([*set().union(*cuts).difference(self.memo)])
        same = [not self.differing or self.differing.isdisjoint(cut) for cut in cuts]
        return [b"".join(map(self.memo.__getitem__, cut)) for cut in cuts], same

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes.__getitem__, np.asarray(ids, np.int32).tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def plain(self, text: str) -> str:
        """What decoding gives for a text whose characters all can be encoded."""
        text = self.normal(text).replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix else text


_HELD: dict[bytes, SentencePieces] = {}


def encoder(raw: bytes) -> SentencePieces:
    """This process's encoder for a model; that of another model is let go."""
    key = hashlib.sha256(raw).digest()
    if key not in _HELD:
        _HELD.clear()
        os.environ["RAYON_NUM_THREADS"] = str(THREADS)  # read at the library's first batch
        _HELD[key] = SentencePieces(raw)
    return _HELD[key]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip, parity of every row. The model file is read on the driver and goes with the code: its size does not grow with the data."""
    with open(model_path, "rb") as f:
        raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column("text").to_pylist()
                ids, parity = pieces.encode(texts)
                same = [pieces.decode(i) == pieces.plain(t) for i, t in zip(ids, texts)]
                sizes = np.array([len(i) for i in ids], np.int64)
                flat = np.concatenate(ids)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), lists, pa.array(same, pa.bool_()), pa.array(parity, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "round_trip", "parity"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(released(run), "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean, parity boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of every row's token_ids; null ids decode to the empty text."""
    with open(model_path, "rb") as f:
        raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(raw)
        for batch in batches:
            texts = [pieces.decode(i.as_py() or []) for i in batch.column("token_ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "token_ids").mapInArrow(released(run), "doc_id long, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
