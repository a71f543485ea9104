"""Near copies at a similarity of their word shingles (0.8, five words), by SimHash and the walk of the binary trie.

At a Jaccard similarity of 0.8 about 0.15 of all fingerprint bits differ, too many for one trie with a small error budget.
So the fingerprint is long, SECTIONS sections of 32 bits, and each section has its own trie that is walked against itself
with a budget of DISTANCE bits, dealt out by blocks as in simhash. A pair at 0.8 comes near in at least one of
the sections with a chance of about 0.95, a pair at 0.9 of over 0.99. Every pair that a walk reports is then held
against the whole fingerprint, and if at most LIMIT of all bits differ, against the texts: it is a link if the Jaccard
similarity of their sets of shingles is SIMILARITY at least.

Texts of few shingles are a matter of chance no more: a fingerprint of few shingles differs in more bits. Where one of two
texts has under FEW shingles, the pair is found by its rarest shingles: of two sets at SIMILARITY, ordered alike, the first
n - ceil(SIMILARITY n) + 1 shingles have one in common. Their whole sets are compared, without LIMIT.

Large groups: equal sections of a component collapse to one before they are dealt out (a grouped minimum), so a subtree holds
few values of a section however many documents there are. Some sections are walked first, in ROUNDS, and report a spanning forest
of the near pairs between components, one pair for each two trees that become one; those whose texts are similar are links, and what
they link is one component in the next round. A pair that fails the check stands in for others there, so at last all sections
are walked for the documents that come near one of another component, and then, with whole fingerprints and those documents alone,
for every such pair: first the closest one of each two components, then all that this leaves apart. What the large groups have in common is one component by then and is left out.

Cases: null text counts as empty; texts without words have the fingerprint zero and link to each other. A text with fewer
words than a shingle is one shingle. Repeats of a shingle count once. Rows with a null id are never linked and stay.
Repeated rows share a component. Extra columns are ignored by near_copies and carried through by keep_one. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, released, settle, sized_broadcast, whole_text
from .components import components
from .simhash import DISTANCE, LOWER, ROWS_PER_TASK, SEED, WORD, Forest, _runs, _walk

SHINGLE, SIMILARITY = 5, 0.8
SECTIONS, WIDTH = 24, 32
#: The sections, from and up to, that are walked in each round for a spanning forest.
ROUNDS = ((0, 12),)
#: Widths of the blocks of a section, one more than DISTANCE.
BLOCKS = (11, 11, 10)
#: Expected share of differing bits at a Jaccard similarity of SIMILARITY, at most; and the bits that differ at three standard deviations more.
SHARE = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
LIMIT = int(SECTIONS * WIDTH * SHARE + 3 * math.sqrt(SECTIONS * WIDTH * SHARE * (1 - SHARE)))

#: Texts of fewer shingles have an exact way, and with them those that can be similar to one.
FEW = 32
#: Pairs of rows written out at once.
PRODUCT = 1 << 20
#: Pairs whose whole fingerprints are compared at once.
COMPARED = 1 << 16

#: The multipliers of the published splitmix64 generator.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SALTS = np.array([(k + 1) * GOLDEN & (1 << 64) - 1 for k in range(SECTIONS * WIDTH // 64)], np.uint64)[:, None]
LANES = np.uint64(0x0101010101010101)


def _ones(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in the salted hashes of h; eight counters at a time in the bytes of a word."""
    groups = -(-len(h) // 255)
    size = -(-len(h) // groups)
    z = h[None, :] + SALTS
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    z ^= z >> np.uint64(31)
    held = np.zeros((len(SALTS), groups * size), np.uint64)
    held[:, : len(h)] = z
    held = held.reshape(len(SALTS), groups, size)
    counts = np.stack([((held >> np.uint64(b)) & LANES).sum(axis=2).view(np.uint8).reshape(len(SALTS), groups, 8).sum(axis=1, dtype=np.int64) for b in range(8)], axis=2)
    return counts.reshape(-1)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the different shingles, in order."""
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    pieces = [" ".join(words)] if len(words) <= shingle else map(" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(p, SEED) for p in pieces), np.uint64))


def similar(a: str, b: str, shingle: int = SHINGLE) -> bool:
    """Whether the sets of shingles have a Jaccard similarity of SIMILARITY; texts without words are alike."""
    x, y = shingles(a, shingle), shingles(b, shingle)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def sketch(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sections of a text's fingerprint. A bit is set if over half of the different shingles set it."""
    return _sketch(shingles(text, shingle))


def _sketch(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(SECTIONS, np.int32)
    ones = sum(_ones(h[at : at + (1 << 15)]) for at in range(0, len(h), 1 << 15))
    return np.packbits(2 * ones > len(h)).view(np.int32)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, the sections of its fingerprint, size, how many different shingles it has, and few, the shingles of a text that has few or can be similar to one of few; null for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py(), shingle) for t in part.column("text")]
                found = np.concatenate([_sketch(h) for h in sets])
                few = pa.array([h.view(np.int64) if len(h) * SIMILARITY < FEW else None for h in sets], pa.list_(pa.int64()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * SECTIONS), pa.array(found))
                sizes = pa.array([len(h) for h in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, sizes, few], ["doc_id", "fp", "size", "few"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(released(run), "doc_id long, fp array<int>, size int, few array<long>")


class WitnessForest(Forest):
    """A forest that keeps the pairs by which it was joined: one for each two trees that became one."""

    def __init__(self, n: int):
        super().__init__(n)
        self.witnesses: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
            label[high[first]] = low[first]
            self.witnesses.append((a[first], b[first]))
            while not np.array_equal(up := label[label], label):
                label[:] = up
        self.settle()


def witness_pairs(group: np.ndarray, value: np.ndarray, node: np.ndarray, comp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes whose values differ in DISTANCE bits at most, enough to join what is not yet one component. Values of a group are distinct and share their first depth bits."""
    order = np.lexsort((value, group))
    group, value, node, comp = group[order], value[order], node[order], comp[order]
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    ends = np.append(cut[1:], len(group))
    out = [(np.zeros(0, np.int64),) * 2]
    for lo, hi in _runs(cut, ends, group, value):
        y, own, starts = value[lo:hi], comp[lo:hi], cut[(cut >= lo) & (cut < hi)] - lo
        stops = np.append(starts[1:], hi - lo)
        roots = np.stack([starts, stops, starts, stops, np.zeros_like(starts)], 1)[stops - starts > 1]
        if not len(roots):
            continue
        forest = WitnessForest(len(y))
        by = np.argsort(own, kind="stable")
        same = own[by][1:] == own[by][:-1]
        forest.join(by[1:][same], by[:-1][same])
        forest.witnesses.clear()
        for allowed in range(1, DISTANCE + 1):
            _walk(y, roots, depth, allowed, forest)
        out += [(node[lo + a], node[lo + b]) for a, b in forest.witnesses]
    return tuple(np.concatenate(x) for x in zip(*out))


class Marked(Forest):
    """Marks the places that come near one of another component. A place of several components has a label of its own."""

    def __init__(self, label: np.ndarray, marked: np.ndarray):
        self.label, self.marked = label, marked
        self.settle()

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        self.marked[a[apart]] = True
        self.marked[b[apart]] = True


def near_others(group: np.ndarray, value: np.ndarray, comp: np.ndarray, depth: int) -> np.ndarray:
    """Which rows come within DISTANCE bits of a row of another component in their group. Values of a group share their first depth bits."""
    out = np.zeros(len(value), bool)
    order, value, _, first, last, low, high, label, held, runs = _places(group, value, comp)
    for lo, hi, roots in runs:
        found = Marked(label[lo:hi], low[lo:hi] != high[lo:hi])
        if len(roots):
            _walk(value[first[lo:hi]], roots, depth, DISTANCE, found)
        for k in (lo + np.flatnonzero(found.marked)).tolist():
            out[order[first[k] : last[k]]] = True
    return out


class Between(Forest):
    """Keeps every pair of places of different components. A place of several components has a label of its own."""

    def __init__(self, label: np.ndarray):
        self.label, self.pairs = label, []
        self.settle()

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = (a < b) & (self.label[a] != self.label[b])
        self.pairs.append((a[apart], b[apart]))


def _places(group: np.ndarray, value: np.ndarray, comp: np.ndarray) -> tuple:
    """Rows in order of group and value, the places of equal values, their components and labels, and stretches of places with the roots of their walks."""
    order = np.lexsort((value, group))
    group, value, comp = group[order], value[order], comp[order]
    if not len(group):
        return order, value, comp, order, order, comp, comp, comp, group, []
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])]))
    last = np.append(first[1:], len(group))
    low, high = np.minimum.reduceat(comp, first), np.maximum.reduceat(comp, first)
    held, names = group[first], np.unique(comp)
    label = np.where(low == high, np.searchsorted(names, low), len(names) + np.arange(len(first)))
    cut = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    ends = np.append(cut[1:], len(held))

    def runs() -> Iterator[tuple[int, int, np.ndarray]]:
        for lo, hi in _runs(cut, ends, held, value[first]):
            starts = cut[(cut >= lo) & (cut < hi)] - lo
            stops = np.append(starts[1:], hi - lo)
            yield lo, hi, np.stack([starts, stops, starts, stops, np.zeros_like(starts)], 1)[stops - starts > 1]

    return order, value, comp, first, last, low, high, label, held, runs()


def all_pairs(group: np.ndarray, value: np.ndarray, comp: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of rows of different components in one group whose values differ in DISTANCE bits at most, PRODUCT or a row's pairs at once. Values of a group share their first depth bits."""
    order, value, comp, first, last, low, high, label, held, runs = _places(group, value, comp)
    for lo, hi, roots in runs:
        found = Between(label[lo:hi])
        if len(roots):
            _walk(value[first[lo:hi]], roots, depth, DISTANCE, found)
        own = np.flatnonzero(low[lo:hi] != high[lo:hi])
        x, y = (lo + np.concatenate(k) for k in zip((own, own), *found.pairs))
        wide = last[y] - first[y]
        rows = (last[x] - first[x]).cumsum()
        # each row of x against all rows of y
        at, of = 0, np.repeat(np.arange(len(x)), last[x] - first[x])
        left = first[x][of] + np.arange(len(of)) - np.concatenate([[0], rows])[of]
        size = wide[of].cumsum()
        while at < len(of):
            to = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + PRODUCT, side="right")), at + 1)
            k = np.repeat(np.arange(at, to), wide[of[at:to]])
            right = first[y][of[k]] + np.arange(len(k)) - np.repeat(size[at:to] - wide[of[at:to]] - (size[at - 1] if at else 0), wide[of[at:to]])
            a, b = left[k], right
            apart = (comp[a] != comp[b]) & ((x != y)[of[k]] | (a < b))
            yield order[a[apart]], order[b[apart]]
            at = to


OFFSETS = (0, BLOCKS[0], BLOCKS[0] + BLOCKS[1])


def _sections(nodes: DataFrame, first: int = 0, last: int = SECTIONS) -> DataFrame:
    """nodes with t, the place of a section from first to last, and s, its value."""
    own = F.slice("fp", first + 1, last - first)
    return nodes.select("*", F.posexplode(own).alias("t", "s")).withColumn("s", F.col("s").cast("long").bitwiseAND((1 << WIDTH) - 1))


def _dealt(held: DataFrame) -> DataFrame:
    """The rows of held once for each block of their section, those of one block value together; a task has ROWS_PER_TASK on average at most."""
    blocks = F.array(*(F.struct(F.lit(r).alias("r"), F.shiftrightunsigned("s", WIDTH - at - w).bitwiseAND((1 << w) - 1).alias("key")) for r, (at, w) in enumerate(zip(OFFSETS, BLOCKS))))
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(held.count() * len(BLOCKS) / ROWS_PER_TASK))
    return held.select("*", F.explode(blocks).alias("block")).select(*held.columns, "block.r", "block.key").repartition(parts, "t", "r", "key")


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray]]:
    """For each block: its number, its rows, their groups, and their sections turned so that the block leads."""
    batches = list(batches)
    if not batches:
        return
    held = pd.concat(batches)
    for r, part in held.groupby("r"):
        s, at = part.s.to_numpy(np.uint64), np.uint64(OFFSETS[r])
        turned = ((s << at) | (s >> (np.uint64(WIDTH) - at))) << np.uint64(WIDTH)
        yield r, part, part.t.to_numpy(np.int64) << 32 | part.key.to_numpy(np.int64), turned


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidates(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """a, b: pairs of nodes of different components (node, comp, fp) that come near in one of the sections first to last, one at least for each two components that could hang together by them."""
    each = _sections(nodes, first, last).groupBy("t", "s", "comp").agg(F.min("node").alias("node"))
    least = each.groupBy("t", "s").agg(F.min(F.struct("comp", "node")).alias("least"), F.count("*").alias("n")).select("t", "s", "least.comp", "least.node", "n")
    held = materialise(least, "similar-sections")
    mixed = held.where("n > 1").select("t", "s", F.col("comp").alias("comp_b"), F.col("node").alias("b"))
    equal = each.join(mixed, ["t", "s"]).where("comp <> comp_b").select(F.col("node").alias("a"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, part, group, turned in _subtrees(batches):
            a, b = witness_pairs(group, turned, part.node.to_numpy(np.int64), part.comp.to_numpy(np.int64), BLOCKS[r])
            yield pd.DataFrame({"a": a, "b": b})

    return _ordered(equal.unionByName(_dealt(held.drop("n")).mapInPandas(released(run), "a long, b long")))


def beside_others(nodes: DataFrame) -> DataFrame:
    """t, node: the sections in which a node (node, comp, fp) comes near one of another component."""
    rows = _sections(nodes).select("t", "s", "comp", "node")
    held = materialise(rows.groupBy("t", "s", "comp").agg(F.min("node").alias("node"), (F.count("*") > 1).alias("more")), "similar-between")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, part, group, turned in _subtrees(batches):
            yield part.loc[near_others(group, turned, part.comp.to_numpy(np.int64), BLOCKS[r]), ["t", "s", "comp", "node", "more"]]

    found = materialise(_dealt(held).mapInPandas(released(run), "t int, s long, comp long, node long, more boolean").distinct(), "similar-beside")
    several = found.where("more").select("t", "s", "comp")
    return found.where("not more").select("t", "node").union(rows.join(sized_broadcast(several), ["t", "s", "comp"]).select("t", "node"))


def candidates_between(nodes: DataFrame) -> DataFrame:
    """a, b, comp_a, comp_b, bits: every pair of nodes of different components (node, comp, fp, least, most) that come near in one of the sections, differ in LIMIT bits of all at most, and have numbers of shingles (from least to most) that similar sets can have."""
    beside = materialise(beside_others(nodes), "similar-sections-beside")
    section = F.element_at("fp", F.col("t") + 1).cast("long").bitwiseAND((1 << WIDTH) - 1)
    held = materialise(nodes.select("node", "comp", "fp", "least", "most").join(beside, "node").select("t", section.alias("s"), "node", "comp", "fp", "least", "most"), "similar-whole")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, part, group, turned in _subtrees(batches):
            node, t, fp = part.node.to_numpy(np.int64), part.t.to_numpy(np.int64), np.stack(part.fp.to_numpy()).astype(np.int32).view(np.uint32)
            least, most = part.least.to_numpy(float), part.most.to_numpy(float)
            comp = part.comp.to_numpy(np.int64)
            for a, b in all_pairs(group, turned, comp, BLOCKS[r]):
                for at in range(0, len(a), COMPARED):
                    x, y = a[at : at + COMPARED], b[at : at + COMPARED]
                    differ = fp[x] ^ fp[y]
                    bits = np.bitwise_count(differ)
                    # a pair is told once, where its first section that comes near has its first equal block
                    first = (bits <= DISTANCE).argmax(axis=1)
                    of = differ[np.arange(len(x)), first]
                    told = (bits.sum(axis=1, dtype=np.int64) <= LIMIT) & (first == t[x])
                    told &= (most[x] >= SIMILARITY * least[y]) & (most[y] >= SIMILARITY * least[x])
                    for k in range(r + 1):
                        told &= ((of >> np.uint32(WIDTH - OFFSETS[k] - BLOCKS[k])) & np.uint32((1 << BLOCKS[k]) - 1) == 0) == (k == r)
                    x, y, bits = x[told], y[told], bits[told].sum(axis=1, dtype=np.int64)
                    turn = node[x] > node[y]
                    x, y = np.where(turn, y, x), np.where(turn, x, y)
                    yield pd.DataFrame({"a": node[x], "b": node[y], "comp_a": comp[x], "comp_b": comp[y], "bits": bits})

    return _dealt(held).mapInPandas(released(run), "a long, b long, comp_a long, comp_b long, bits long")


def closest(pairs: DataFrame) -> DataFrame:
    """a, b: for each two components that come near each other the pair of the fewest differing bits."""
    best = pairs.groupBy(F.least("comp_a", "comp_b").alias("x"), F.greatest("comp_a", "comp_b").alias("y")).agg(F.min(F.struct("bits", "a", "b")).alias("best"))
    return best.select("best.a", "best.b")


def still_apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """a, b, of pairs those whose components the links found (a, b nodes of pairs) leave apart."""
    named = pairs.select("a", "b", "comp_a", "comp_b").join(found, ["a", "b"], "left_semi").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    root = components(named)
    rest = pairs.join(root.toDF("comp_a", "root_a"), "comp_a", "left").join(root.toDF("comp_b", "root_b"), "comp_b", "left")
    return rest.where(F.coalesce("root_a", "comp_a") != F.coalesce("root_b", "comp_b")).select("a", "b")


def within_limit(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, of the pairs of nodes those that differ in LIMIT bits at most."""
    fp = nodes.select("node", "fp")
    pairs = pairs.join(fp.toDF("a", "fp_a"), "a").join(fp.toDF("b", "fp_b"), "b")
    differ = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND((1 << WIDTH) - 1))), F.lit(0), lambda n, x: n + x)
    return pairs.where(differ <= LIMIT).select("a", "b")


def links(docs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """a, b, of the pairs of nodes those whose texts are similar; the texts of other documents are not moved."""
    pairs = materialise(pairs, "similar-pairs")
    needed = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "similar-texts-of")
    own = docs.select(F.col("doc_id").cast("long").alias("node"), whole_text().alias("text")).join(sized_broadcast(needed), "node")
    texts = materialise(own, "similar-texts")

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y, shingle) for x, y in zip(a, b)], dtype=bool)

    with_texts = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return with_texts.where(alike("text_a", "text_b")).select("a", "b").distinct()


def rarest(nodes: DataFrame) -> DataFrame:
    """node, few and h, for each of the rarest shingles of which similar sets have one in common."""
    each = nodes.where("few is not null").select("node", F.explode("few").alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("n"))
    sets = each.join(counts, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("held"))
    n = F.size("held")
    # whole numbers: SIMILARITY is four fifths
    first = F.slice("held", F.lit(1), (n - F.ceil(n * F.lit(4) / F.lit(5)) + 1).cast("int"))
    return sets.select("node", F.explode(first).alias("of")).where("of.n > 1").select("node", "of.h")


def few_links(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, of the pairs those whose sets few are similar."""
    sets = nodes.where("few is not null").select("node", "few")
    held = pairs.distinct().join(sets.toDF("a", "few_a"), "a").join(sets.toDF("b", "few_b"), "b")
    both = F.size(F.array_intersect("few_a", "few_b"))
    return held.where(both >= SIMILARITY * (F.size("few_a") + F.size("few_b") - both)).select("a", "b")


def few_between(posted: DataFrame, named: DataFrame) -> DataFrame:
    """a, b: pairs of nodes of different components with a rarest shingle in common."""
    rows = posted.join(named.select("node", "comp"), "node")
    mixed = rows.groupBy("h").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("h")
    rows = rows.join(mixed, "h")
    x, y = rows.toDF("h", "a", "comp_a"), rows.toDF("h", "b", "comp_b")
    return x.join(y, "h").where("a < b and comp_a <> comp_b").select("a", "b")


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with comp, the smallest node that edges reach."""
    joined = components(edges).withColumnRenamed("root", "comp")
    return materialise(nodes.join(joined, "node", "left").select("node", "fp", "few", "least", "most", F.coalesce("comp", "node").alias("comp")), "similar-named")


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of its near copies, itself included) of every row; null for a null id."""
    rows = materialise(sketches(docs, shingle), "similar-fp")
    nodes = materialise(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.min_by("few", "doc_id").alias("few"), F.min("size").alias("least"), F.max("size").alias("most")), "similar-nodes")
    posted = materialise(rarest(nodes), "similar-rarest")
    star = posted.join(posted.groupBy("h").agg(F.min("node").alias("a")), "h").where("a < node").select("a", F.col("node").alias("b"))
    edges = materialise(few_links(nodes, star), "similar-few")
    named = nodes.withColumn("comp", F.col("node"))
    for first, last in ROUNDS:
        found = materialise(links(docs, within_limit(named, candidates(named, first, last)), shingle), "similar-links")
        edges = edges.unionByName(found)
        named = _named(nodes, edges)
        settle(docs.sparkSession)
    between = materialise(candidates_between(named), "similar-candidates")
    near = materialise(links(docs, closest(between), shingle), "similar-closest")
    late = links(docs, still_apart(between, near), shingle).unionByName(few_links(nodes, few_between(posted, named)))
    root = components(edges.unionByName(near).unionByName(materialise(late, "similar-late")))
    names = materialise(nodes.join(root, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")), "similar-names")
    return rows.join(names, "fp", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with one document of each component, the one that names it."""
    dropped = materialise(near_copies(docs, shingle).where("doc_id <> component_id").select("doc_id").distinct(), "similar-dropped")
    return docs.join(sized_broadcast(dropped), "doc_id", "left_anti").select(*docs.columns)
