"""Near duplicates by SimHash, joined by walking a binary trie against itself.

Every text becomes a 64-bit fingerprint; equal fingerprints collapse to one before anything is compared.
Fingerprints within DISTANCE bits agree in at least one of three blocks of bits, so the trie is dealt out
by block: each fingerprint goes once to each of three subtrees (its bits turned so that the block leads).
Below a subtree's root pairs of nodes are walked together, the differing bits add up, and a pair is left
as soon as they exceed the budget. Walks give a spanning forest of the links, never all pairs; the forests
are joined to components by alternating large-star and small-star steps over tables in the shared folder.

A subtree with more than HOT_SUBTREE distinct fingerprints is split once more: by all pairs of its nodes
SPLIT_BITS further down that are still within the budget.

Cases: null text counts as empty; texts without words have fingerprint zero and link like any other;
repeated rows and ties share a component; a null id never becomes a component's name unless all of its ids
are null. Extra columns are ignored by near_duplicates and carried through by keep_one. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, released, sized_broadcast, whole_text
from .components import components

BITS, DISTANCE, SHINGLE, SEED = 64, 2, 3, 42
#: Widths of the blocks, one more than DISTANCE.
BLOCKS = (22, 21, 21)
HOT_SUBTREE, SPLIT_BITS = 200_000, 8
#: Fingerprint copies that one task walks, on average; bounds its memory.
ROWS_PER_TASK = 1_000_000
#: Node pairs expanded at once, and the product of sizes under which two nodes are compared outright.
FRONTIER, LEAF_PAIRS = 1 << 18, 64

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    if len(words) <= shingle:
        pieces = [" ".join(words)]
    else:
        pieces = map(" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in pieces), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = np.array([fingerprint(t.as_py(), shingle) for t in part.column("text")], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(released(run), "doc_id long, fp long")


class Forest:
    """Labels 0 .. n-1; joining a and b gives both, and all that hang together with them, the smaller label."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.settle()

    def settle(self) -> None:
        self.breaks = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else np.zeros(0, int)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up
        self.settle()

    def one(self, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """Where both ranges lie in one component."""
        return (self.breaks[lo] == self.breaks[hi - 1]) & (self.breaks[lo2] == self.breaks[hi2 - 1]) & (self.label[lo] == self.label[lo2])


def _walk(y: np.ndarray, roots: np.ndarray, depth: int, budget: int, forest: Forest) -> None:
    """Walks the trie over the sorted, distinct y against itself, from the node pairs (lo, hi, lo, hi, differing bits) in roots."""
    stack = [(roots, depth)]
    while stack:
        pairs, depth = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [(pairs[FRONTIER:], depth), (pairs[:FRONTIER], depth)]
            continue
        pairs = pairs[~forest.one(pairs[:, 0], pairs[:, 1], pairs[:, 2], pairs[:, 3])]
        size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = (size <= LEAF_PAIRS) | (depth >= BITS)
        leaves, pairs, size = pairs[small], pairs[~small], size[small]
        if len(leaves):
            of = np.repeat(np.arange(len(leaves)), size)
            k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            wide = leaves[of, 3] - leaves[of, 2]
            a, b = leaves[of, 0] + k // wide, leaves[of, 2] + k % wide
            near = (a != b) & (np.bitwise_count(y[a] ^ y[b]) <= budget)
            forest.join(a[near], b[near])
        if not len(pairs):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)

        def middle(lo, hi, bit=bit):
            return np.clip(np.searchsorted(y, (y[lo] & ~(bit | (bit - np.uint64(1)))) | bit), lo, hi)

        lo, hi, lo2, hi2, diff = pairs.T
        m, m2, same = middle(lo, hi), middle(lo2, hi2), lo == lo2
        nodes = [np.stack(p, 1) for p in ((lo, m, lo2, m2, diff), (m, hi, m2, hi2, diff), (lo, m, m2, hi2, diff + 1))]
        nodes.append(np.stack((m, hi, lo2, m2, diff + 1), 1)[~same])
        new = np.concatenate(nodes)
        new = new[(new[:, 4] <= budget) & (new[:, 0] < new[:, 1]) & (new[:, 2] < new[:, 3])]
        stack.append((new[(new[:, 0] != new[:, 2]) | (new[:, 1] - new[:, 0] > 1)], depth + 1))


def trie_forest(group: np.ndarray, turned: np.ndarray, depth: int, budget: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """For each group of distinct values that share their first depth bits, a spanning forest of the links within budget: (value, smaller value) pairs."""
    order = np.lexsort((turned, group))
    group, turned = group[order], turned[order]
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    ends = np.append(cut[1:], len(group))
    out = []
    for lo, hi in _runs(cut, ends, group, turned):
        y, starts = turned[lo:hi], cut[(cut >= lo) & (cut < hi)] - lo
        stops = np.append(starts[1:], hi - lo)
        many = stops - starts > 1
        roots = np.stack([starts, stops, starts, stops, np.zeros_like(starts)], 1)[many]
        if not len(roots):
            continue
        forest = Forest(len(y))
        for allowed in range(1, budget + 1):  # close links first: what they join is then left out at once
            _walk(y, roots, depth, allowed, forest)
        moved = np.flatnonzero(forest.label != np.arange(len(y)))
        out.append((y[moved], y[forest.label[moved]]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64),) * 2


def _runs(cut: np.ndarray, ends: np.ndarray, group: np.ndarray, turned: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of groups over which the values ascend, so that one search serves all groups of a stretch."""
    start = None
    for i, (lo, hi) in enumerate(zip(cut, ends)):
        if start is None:
            start = lo
        if i + 1 == len(cut) or turned[ends[i] - 1] >= turned[cut[i + 1]]:
            yield int(start), int(hi)
            start = None


def _turn(fp: np.ndarray, by: int) -> np.ndarray:
    by = np.uint64(by)
    return fp if by == 0 else (fp << by) | (fp >> (np.uint64(BITS) - by))


def links(distinct: DataFrame, budget: int = DISTANCE, hot: int = HOT_SUBTREE) -> DataFrame:
    """a, b: links within budget between different fingerprints (column fp), enough to give the same components as all of them."""
    if budget != DISTANCE:
        raise ValueError(f"the blocks are laid out for a distance of {DISTANCE}")
    spark = distinct.sparkSession
    distinct = distinct.select("fp")
    offset = np.concatenate([[0], np.cumsum(BLOCKS)[:-1]]).tolist()
    subtree = [F.struct(F.lit(r).alias("r"), F.shiftrightunsigned(F.shiftleft("fp", at) if at else F.col("fp"), BITS - w).alias("key")) for r, (at, w) in enumerate(zip(offset, BLOCKS))]
    dealt = distinct.select("fp", F.explode(F.array(*subtree)).alias("s")).select("fp", "s.r", "s.key")
    crowded = materialise(dealt.groupBy("r", "key").count().where(F.col("count") > hot).select("r", "key"), "simhash-hot")
    split = not crowded.isEmpty()
    pair = F.lit(None).cast("long")
    if split:
        crowded = sized_broadcast(crowded)
        near = [[q for q in range(1 << SPLIT_BITS) if (p ^ q).bit_count() <= budget] for p in range(1 << SPLIT_BITS)]
        table = spark.createDataFrame([(p, min(p, q) << SPLIT_BITS | max(p, q)) for p in range(1 << SPLIT_BITS) for q in near[p]], "node long, pair long")
        start = [F.lit(a + w) for a, w in zip(offset, BLOCKS)]
        at = F.when(F.col("r") == 0, start[0]).when(F.col("r") == 1, start[1]).otherwise(F.lit(0))
        node = F.expr(f"shiftrightunsigned(shiftleft(fp, at), {BITS - SPLIT_BITS})")
        inside = dealt.join(crowded, ["r", "key"]).withColumn("at", at.cast("int")).withColumn("node", node).join(F.broadcast(table), "node").select("fp", "r", "key", "pair")
        dealt = dealt.join(crowded, ["r", "key"], "left_anti").withColumn("pair", pair).unionByName(inside)
    else:
        dealt = dealt.withColumn("pair", pair)
    n = distinct.count() * len(BLOCKS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / ROWS_PER_TASK))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        rows = pd.concat(held)
        for r, own in rows.groupby("r"):
            y = _turn(own.fp.to_numpy(np.int64).view(np.uint64), offset[r])
            group = own.groupby(["key", own.pair.fillna(-1)], sort=True).ngroup().to_numpy()
            a, b = trie_forest(group, y, BLOCKS[r])
            back = (BITS - offset[r]) % BITS
            yield pd.DataFrame({"a": _turn(a, back).view(np.int64), "b": _turn(b, back).view(np.int64)})

    return dealt.repartition(parts, "r", "key", "pair").mapInPandas(released(run), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    rows = materialise(fingerprints(docs, shingle), "simhash-fp")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    joined = components(materialise(links(distinct), "simhash-links"))
    named = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = materialise(named.join(least, "root").select("fp", "component_id"), "simhash-names")
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with one document of each component, the one that names it; rows with a null id stay unless a named row shares their component."""
    found = materialise(near_duplicates(docs, shingle), "simhash-found")
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    out = docs.join(sized_broadcast(dropped), "doc_id", "left_anti").select(*docs.columns)
    return out


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
