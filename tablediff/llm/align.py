"""Cross-tokenizer alignment: the minimal groups of tokens of two vocabularies that cover the same bytes, and corpus-wide counts of linked tokens.

Tokens of A and B are the two sides of a graph with an edge where their byte ranges overlap; a union-find over its edges gives the
connected components, which are exactly the minimal groups. All A-B pairs within a component are links.

Where both vocabularies are proven to break at a blank after a visible character (A is plain byte-level BPE, no piece of B goes on
over the start of a word), no group goes over such a place. A text is then a sequence of units, each worked out once by
a worker that remembers UNITS of them; otherwise the text is one unit. Encoding, union-find and digests run in Arrow batches.

Counts are DataFrame work: each document's distinct pairs are written once, exploded, and counted with partial sums before the
shuffle. The counts come back to the documents by a join, by broadcast if the table of pairs has at most PAIRS rows (three numbers
each), else by a shuffle that Spark may split where a pair is frequent.

Cases: texts that are null or empty, or whose tokens do not spell a blank and the text byte for byte (the white-space marker of B in a
text, unknown characters without byte fallback), have no tokens: numbers are 0, groups_sha256 is ''. Special tokens' strings are plain text. Ties: every B id that
reaches an A id's highest count is best. Repeated rows and null ids are documents of their own. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, released, whole_text
from .sentence_piece import BYTE, MARK, THREADS, parse_model, splits_at_words
from .token_count import LOW_END, byte_chars, is_plain_byte_level, low_pattern

#: Units that a worker remembers before it starts anew, units that are worked out at once, and characters of a text that are cut at once.
UNITS, AT_ONCE, PIECE = 250_000, 4096, 1 << 19
#: A table of pair counts of at most so many rows, of 24 bytes each, is broadcast.
PAIRS = 1_500_000
#: Bits of an id where two ids and a place are packed into one number.
BITS = 22


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... (sizes[i] of them) for every i, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def connected(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for the edges u[i] - v[i] among n nodes.

    Union-find over whole arrays: for every edge whose ends have different roots the larger root is put under the smaller one,
    then all paths are halved until they are flat; again until no edge joins two roots.
    """
    parent = np.arange(n)
    while True:
        x, y = parent[u], parent[v]
        open_ = x != y
        if not open_.any():
            return parent
        u, v, x, y = u[open_], v[open_], x[open_], y[open_]
        parent[np.maximum(x, y)] = np.minimum(x, y)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of its component, from 0 in order, for each A and each B token. ends are the places where tokens end; both sides end at the same place."""
    m = len(ends_a)
    starts = np.concatenate([[0], ends_a[:-1]])
    first, last = np.searchsorted(ends_b, starts, "right"), np.searchsorted(ends_b, ends_a, "left")
    over = last - first + 1  # the B tokens that an A token overlaps
    root = connected(m + len(ends_b), np.repeat(np.arange(m), over), m + spread(first, over))
    # every component has an A token, and A tokens have the smaller numbers
    new = np.cumsum(root[:m] == np.arange(m)) - 1
    return new[root[:m]], new[root[m:]]


class _Memo(dict):
    """Unit to its place; a unit that is not there gets the next one and waits to be worked out."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = at = len(self)
        self.new.append(unit)
        return at


class _Rows:
    """Rows of numbers, one after the other, in an array that grows by doubling."""

    def __init__(self, width: int):
        self.held, self.n = np.empty((1024, width), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        need = self.n + len(rows)
        if need > len(self.held):
            grown = np.empty((max(need, 2 * len(self.held)), self.held.shape[1]), np.int64)
            grown[: self.n] = self.held[: self.n]
            self.held = grown
        self.held[self.n : need] = rows
        self.n = need


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0 to n - 1, a row each, with zero bytes after them."""
    width = len(str(n))
    return np.array([str(i) for i in range(n)], f"S{width}").view(np.uint8).reshape(n, width)


class Aligner:
    def __init__(self, spec: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        m, back = parse_model(model), byte_chars()
        self.mark = self.b.piece_to_id(MARK)
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        plain = lambda t: bytes(map(back.__getitem__, t)) if all(c in back for c in t) else t.encode()
        self.bytes_a = [plain(names.get(i, "")) for i in range(max(names) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds)]
        self.size_a, self.size_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        self.plain_a = is_plain_byte_level(json.loads(spec))
        self.by_unit = self.plain_a and splits_at_words(m) and m.dummy_prefix and not m.remove_extra and not m.charsmap
        self.pre_tokens, self.unproven = low_pattern().findall, re.compile(f"[^\\u0000-\\u{LOW_END - 1:04x}]").search
        self.stand_in = {b: c for c, b in back.items()}
        self.cut, self.unsafe = re.compile(" *[^ ]+| +").findall, re.compile(r"[^!-~\w ] ").search
        self.split, self.start = re.compile(r"(?<=[!-~\w])(?= )").split, re.compile(r"(?<=[!-~\w]) ")
        self.digits = _digits(len(self.bytes_a)), _digits(len(self.bytes_b))
        self._forget()

    def _forget(self) -> None:
        #: Of each unit: n_a, n_b, n_groups, n_links, its first pair and how many; the pairs (a, b, links); its groups as text.
        self.memo, self.sums, self.pairs, self.texts = _Memo(), _Rows(6), _Rows(3), []
        self.bad: set[int] = set()
        self.known: dict[str, list[int]] = {}  # A's ids of pre-tokens

    def units(self, text: str) -> list[str]:
        """The text, which begins with a blank, cut before blanks that follow a visible character; the first blank of each unit is left out."""
        if not self.by_unit:
            return [text[1:]]
        if self.unsafe(text):
            return [u[1:] for u in self.split(text)]
        return [u[1:] for u in self.cut(text)] if "  " in text or text[-1] == " " else text[1:].split(" ")

    def pieces(self, text: str) -> Iterator[str]:
        """A text in pieces of about PIECE characters that end where a unit begins."""
        at = 0
        while self.by_unit and len(text) - at > PIECE and (m := self.start.search(text, at + PIECE)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def ids_a(self, units: list[str]) -> tuple[list[int], list[int]]:
        """A's ids of a blank and the unit, all in a row, and how many each unit has. Below LOW_END the classes of its pre-tokens are proven (see token_count), so a pre-token is merged on its own."""
        flat, sizes, merge, known = [], [], self.a.model.tokenize, self.known
        proven = self.plain_a and not self.unproven("".join(units))
        for unit in units:
            own, before = " " + unit, len(flat)
            if not proven and (not self.plain_a or self.unproven(unit)):
                flat += self.a.encode(own, add_special_tokens=False).ids
            elif unit.isalpha() and unit.isascii():  # one pre-token; the whole unit is remembered, so it is not
                flat += [t.id for t in merge("\u0120" + unit)]
            else:
                for p in self.pre_tokens(own):
                    if p not in known:
                        known[p] = [t.id for t in merge(p.encode().decode("latin-1").translate(self.stand_in))]
                    flat += known[p]
            sizes.append(len(flat) - before)
        return flat, sizes

    def ids_b(self, units: list[str]) -> tuple[list[int], list[int]]:
        """B's ids of the units, all in a row, and how many each has. Many units go into a text where no piece goes over the start of a unit; units that are all blanks would join the next."""
        flat, sizes = [], []
        for at in range(0, len(units), 256):
            own = units[at : at + 256]
            if self.by_unit and all(u.strip(" ") for u in own):
                ids = self.b.encode(" ".join(own))
                ends = np.cumsum(np.fromiter(map(len, map(str.encode, own)), np.int64, len(own)) + 1)
                spelled = np.cumsum(self.size_b[ids])
                edges = np.searchsorted(spelled, ends)
                if edges[-1] == len(ids) - 1 and (spelled[edges] == ends).all():
                    flat += ids
                    sizes += np.diff(edges, prepend=-1).tolist()
                    continue
            for ids in self.b.encode(own, num_threads=1):
                ids = ids or [self.mark]  # the library gives nothing for an empty text
                flat += ids
                sizes.append(len(ids))
        return flat, sizes

    def _spelled(self, units: list[str], flat: list[int], sizes: list[int], pieces: list[bytes]) -> list[bool]:
        """Whether the ids of each unit spell a blank and the unit."""
        if b"".join([pieces[i] for i in flat]) == (" " + " ".join(units)).encode():
            return [True] * len(units)
        ends = np.cumsum(sizes).tolist()
        return [b"".join([pieces[i] for i in flat[y - n : y]]) == b" " + u.encode() for u, n, y in zip(units, sizes, ends)]

    def learn(self, units: list[str]) -> None:
        """Works out units, which get the next places."""
        (a, n_a), (b, n_b), first = self.ids_a(units), self.ids_b(units), len(self.texts)
        good = np.logical_and(self._spelled(units, a, n_a, self.bytes_a), self._spelled(units, b, n_b, self.bytes_b))
        a, n_a, b, n_b = (np.array(x, np.int64) for x in (a, n_a, b, n_b))
        sums, texts = np.zeros((len(units), 6), np.int64), [b""] * len(units)
        sums[:, 4] = self.pairs.n
        if not good.all():
            self.bad.update((first + np.flatnonzero(~good)).tolist())
            a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a[good], n_b[good]
        if len(a):
            numbers, pairs, found = self._aligned(a, b, n_a, n_b)
            numbers[:, 4] += self.pairs.n
            sums[good] = numbers
            self.pairs.add(pairs)
            if good.all():
                texts = found
            else:
                for i, t in zip(np.flatnonzero(good).tolist(), found):
                    texts[i] = t
        self.sums.add(sums)
        self.texts += texts

    def _aligned(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Sums, pairs and groups as text of units that both sides spell alike."""
        in_a, in_b = components(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        m, k = np.bincount(in_a), np.bincount(in_b)  # tokens of each side in each group
        unit = np.repeat(np.arange(len(n_a)), n_a)[np.cumsum(m) - 1]  # of each group
        # a group's distinct ids of both sides, then their pairs
        code_a, times_a = np.unique(in_a << BITS | a, return_counts=True)
        code_b, times_b = np.unique(in_b << BITS | b, return_counts=True)
        start = np.searchsorted(code_b >> BITS, np.arange(len(m) + 1))
        of = code_a >> BITS
        each = start[of + 1] - start[of]
        there = spread(start[of], each)
        code = np.repeat(unit[of] << 2 * BITS | (code_a & (1 << BITS) - 1) << BITS, each) | code_b[there] & (1 << BITS) - 1
        links = np.repeat(times_a, each) * times_b[there]
        code, links = _summed(code, links)
        place = code >> 2 * BITS
        pairs = np.stack([code >> BITS & (1 << BITS) - 1, code & (1 << BITS) - 1, links], 1)
        of_unit = lambda x: np.bincount(unit, x, len(n_a)).astype(np.int64)
        edges = np.searchsorted(place, np.arange(len(n_a) + 1))
        sums = np.stack([n_a, n_b, of_unit(np.ones(len(m))), of_unit(m * k), edges[:-1], np.diff(edges)], 1)
        # the text: tokens by group, A before B; zero bytes after short numbers are dropped
        width = max(d.shape[1] for d in self.digits)
        chars = np.zeros((len(a) + len(b), width + 1), np.uint8)
        at_a = np.arange(len(a)) + (np.cumsum(k) - k)[in_a]
        at_b = np.arange(len(b)) + np.cumsum(m)[in_b]
        chars[at_a, : self.digits[0].shape[1]] = self.digits[0][a]
        chars[at_b, : self.digits[1].shape[1]] = self.digits[1][b]
        chars[:, width] = ord(",")
        chars[at_a[np.cumsum(m) - 1], width] = ord("|")
        chars[at_b[np.cumsum(k) - 1], width] = np.where(np.append(np.diff(unit) > 0, True), ord("\n"), ord(";"))
        flat = chars.ravel()
        return sums, pairs, flat[flat != 0].tobytes().split(b"\n")[:-1]

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links of each text, its digest, how many distinct pairs it has, and these (a, b, links)."""
        if len(self.memo) > UNITS:
            self._forget()
        held, places = [], []
        for text in texts:
            own = [list(map(self.memo.__getitem__, self.units(p))) for p in self.pieces(" " + text)] if text else []
            held.append(own)
            places.append(np.fromiter(chain.from_iterable(own), np.int64, sum(map(len, own))))
            self._work()
        self._work(True)
        digests = []
        for i, own in enumerate(held):
            if not own or self.bad and any(not self.bad.isdisjoint(x) for x in own):
                places[i] = places[i][:0]
                digests.append("")
                continue
            digest = hashlib.sha256()
            for j, x in enumerate(own):
                digest.update((b";" if j else b"") + b";".join(map(self.texts.__getitem__, x)))
            digests.append(digest.hexdigest())
        sizes = np.array(list(map(len, places)))
        code, times = np.unique(np.repeat(np.arange(len(texts)), sizes) << 32 | np.concatenate(places), return_counts=True)
        text, rows = code >> 32, self.sums.held[code & 0xFFFFFFFF]
        sums = np.stack([np.bincount(text, rows[:, i] * times, len(texts)) for i in range(4)], 1).astype(np.int64)
        found = self.pairs.held[spread(rows[:, 4], rows[:, 5])]
        code, links = _summed(np.repeat(text, rows[:, 5]) << 2 * BITS | found[:, 0] << BITS | found[:, 1], found[:, 2] * np.repeat(times, rows[:, 5]))
        return sums, digests, np.bincount(code >> 2 * BITS, minlength=len(texts)), np.stack([code >> BITS & (1 << BITS) - 1, code & (1 << BITS) - 1, links])

    def _work(self, all_: bool = False) -> None:
        new = self.memo.new
        while len(new) >= AT_ONCE or all_ and new:
            self.learn(new[:AT_ONCE])
            del new[:AT_ONCE]


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order and the sum of n for each."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first) if len(first) else n


_HELD: dict[bytes, Aligner] = {}


def aligner(spec: str, model: bytes) -> Aligner:
    """This process's aligner for two vocabularies; that of others is let go."""
    key = hashlib.sha256(spec.encode() + model).digest()
    if key not in _HELD:
        _HELD.clear()
        os.environ["RAYON_NUM_THREADS"] = str(THREADS)  # read at the library's first batch
        _HELD[key] = Aligner(spec, model)
    return _HELD[key]


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:long>>"


def align(docs: DataFrame, tokenizer_path: str, model_path: str) -> DataFrame:
    """Sums, digest of the groups and distinct pairs of every row. Both files are read on the driver and go with the code: their size does not grow with the data."""
    with open(tokenizer_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        spec, model = f.read(), g.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(spec, model)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sums, digests, sizes, (a, b, n) = both.align(part.column("text").to_pylist())
                pairs = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n)], ["a", "b", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *map(pa.array, sums.T), pa.array(digests), lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(released(run), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, docs, best: in how many documents the pair is linked, and whether that is the highest count of its A id."""
    counts = materialise(aligned.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("docs")), "align-counts")
    highest = counts.groupBy("a").agg(F.max("docs").alias("most"))  # a row for each entry of A at most
    return counts.join(F.broadcast(highest), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def link(docs: DataFrame, tokenizer_path: str, model_path: str, most_pairs: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    found = materialise(align(docs, tokenizer_path, model_path), "align-documents")
    counts = pair_counts(found)
    if counts.count() <= most_pairs:
        counts = F.broadcast(counts)
    each = found.select("row", F.explode("pairs").alias("p")).select("row", "p.*")
    sums = each.join(counts, ["a", "b"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.drop("pairs").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return link(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
