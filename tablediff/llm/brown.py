"""Language-model scoring by Brown classes: exchange clustering of words into classes, class transitions and word emissions.

Texts are cut into words once, in blocks of about BLOCK_BYTES; a block is one row with its documents, its distinct words and its
tokens as places among these. Words are counted over all blocks. The CORE most frequent words are nodes of their own; all others are
nodes together, by their last bytes, in ENDINGS groups, so every word has a node that a task can tell from the word itself and
a table of CORE words. Bigrams of nodes are counted over all training texts and gathered by node: a row for each node,
with at most as many neighbours as there are nodes.

Exchange: in each round tasks try half of the nodes, in turns, in every class, and propose those that another class makes likelier. Moves that are made at
once would spoil each other, so the proposals are taken one by one, each tried again with the counts as moved so far; they are no more than
there are nodes. Counts are made anew for the next round, and the likeliest round is kept.
The end of a text is a word of a class of its own, and stands before the first word too.

    P(w | before) = MIX * P(class(w) | class(before)) * P(w | class(w)) + (1 - MIX) * base(w)

Transitions are smoothed towards the share of the class by PRIOR counts. Emissions are discounted by D = n1 / (n1 + 2 n2) (words seen
once and twice); what is taken away in a class is the probability of an unknown word in it, whose class is that of its ending. Unknown words of a class are
one word, as they are for base.

Only tables whose size is set by parameters go with the code or through the driver: CORE words, CORE + ENDINGS classes, CLASSES squared transitions. Counts of words meet the blocks by a join.

Cases: a null or empty text is one token, the end. Repeated rows and null ids are documents of their own; null ids are learned from. Ties between classes go to
the lower number, words of one count are all core or all not. Extra columns are ignored. Without training texts every word is unknown. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, released, ship, unship

#: Rows whose crc32(doc_id as text) modulo TENTHS is 0 are held out.
TENTHS = 10
CLASSES, CORE, ENDINGS, ENDING_BYTES, ROUNDS = 64, 4096, 2048, 3, 10
MIX, PRIOR, BASE = 0.99, 2.0, 0.1
BLOCK_BYTES = 16 << 20
END = b""  # no word is empty

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, tokens array<int>, words array<binary>, seen array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class _Places(dict):
    """Word to its place in the block, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def _block(block: int, ids: list, held: list, sizes: list, tokens: list, places: dict) -> pa.RecordBatch:
    tokens, sizes = np.concatenate(tokens), np.array(sizes, np.int64)
    learned = np.repeat(~np.array(held, bool), sizes)
    seen = np.bincount(tokens[learned], minlength=len(places))
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [pa.array([block], pa.int64()), one(pa.array(ids, pa.int64())), one(pa.array(held, pa.bool_())), one(pa.array(sizes)), one(pa.array(tokens)), one(pa.array(list(places), pa.binary())), one(pa.array(seen))]
    return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "held", "sizes", "tokens", "words", "seen"])


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in blocks: ids, whether held out, tokens of each; all tokens, one end after each text; distinct words, and how often the training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, fresh = TaskContext.get().partitionId() << 32, lambda: ([], [], [], [], _Places({END: 0}), 0)
        ids, held, sizes, tokens, places, size = fresh()
        for batch in batches:
            for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("bytes")):
                words = text.as_py().translate(_LOWER).split()
                ids.append(doc_id)
                held.append(out)
                sizes.append(len(words) + 1)
                tokens.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
                tokens.append(np.zeros(1, np.int32))
                size += len(text.as_buffer()) + 16
                if size >= block_bytes:
                    yield _block(number, ids, held, sizes, tokens, places)
                    number += 1
                    ids, held, sizes, tokens, places, size = fresh()
        if ids:
            yield _block(number, ids, held, sizes, tokens, places)

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TENTHS == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold, F.lit(False)).alias("held"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    return rows.mapInArrow(released(run), BLOCKS)


def nodes_of(words: list[bytes], core: dict[bytes, int], endings: int) -> np.ndarray:
    """The node of each word: its own, or that of its ending."""
    n, get = len(core), core.get
    return np.array([x if (x := get(w)) is not None else n + crc32(w[-ENDING_BYTES:]) % endings for w in words], np.int64)


def core_words(vocabulary: DataFrame, most: int) -> dict[bytes, int]:
    """Words to nodes: the end of a text first, then all words over the lowest step of counts that no more than most words reach; most bounds what the driver gets."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    left, lowest = most - 1, None
    for r in vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():  # under 1,024 rows
        left -= r.words
        if left < 0:
            break
        lowest = r.step
    found = [] if lowest is None else vocabulary.where(step >= lowest).collect()
    ordered = sorted((r for r in found if bytes(r.word) != END), key=lambda r: (-r.n, bytes(r.word)))
    return {w: i for i, w in enumerate([END, *(bytes(r.word) for r in ordered)])}


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block, the token before each (the end before a first one), and whether each is learned from."""
    tokens, sizes = row["tokens"].astype(np.int64), row["sizes"]
    before = np.concatenate([[0], tokens[:-1]])  # a text's last token is the end, place 0
    return tokens, before, np.repeat(~row["held"], sizes)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: (batch.column(n)[i].values if pa.types.is_list(batch.column(n).type) else batch.column(n)[i]) for n in batch.schema.names}


def _arrays(row: dict) -> dict:
    """numpy arrays of a row's lists, but for words."""
    return {n: v.to_numpy(zero_copy_only=False) if n not in ("words", "block") else v for n, v in row.items()}


def neighbours(found: DataFrame, core: dict[bytes, int], endings: int = ENDINGS) -> DataFrame:
    """node, after (nodes that follow it), before (nodes that it follows) with counts, over all training tokens: a row for each node."""
    spark, n = found.sparkSession, len(core) + endings
    shared = ship(spark, core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unship(shared)
        for row in map(_arrays, _rows(batches)):
            node = nodes_of(row["words"].to_pylist(), own, endings)
            tokens, before, learned = _tokens(row)
            code, count = np.unique(node[before[learned]] * n + node[tokens[learned]], return_counts=True)
            for at in range(0, len(code), 1 << 16):
                part, times = code[at : at + (1 << 16)], count[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(times)], ["code", "n"])

    pairs = found.select("held", "sizes", "tokens", "words").mapInArrow(released(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    pairs = materialise(pairs.select(F.expr(f"code div {n}").alias("v"), (F.col("code") % n).alias("w"), "n"), "brown-bigrams")
    side = lambda a, b, name: pairs.groupBy(F.col(a).alias("node")).agg(F.collect_list(F.struct(F.col(b).alias("other"), "n")).alias(name))  # noqa: E731  at most n entries
    return materialise(side("v", "w", "after").join(side("w", "v", "before"), "node", "full_outer"), "brown-neighbours")


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_class(m: np.ndarray, before: np.ndarray, after: np.ndarray, own: int, self_count: float, fixed: int = 1) -> tuple[int, float]:
    """The class in which a word makes the class bigrams likeliest, and how much likelier than in its own.

    m: counts of class bigrams, the word included; before and after: how often a word of each class stands before and after it. Classes
    under fixed are not entered.
    """
    m, left, right = m.copy(), before.astype(float), after.astype(float)
    m[:, own] -= left
    m[own, :] -= right
    m[own, own] += self_count
    left[own] -= self_count
    right[own] -= self_count
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    held = _f(m)
    gain = (_f(m[a] + left[a, None]) - held[a]).sum(0) + (_f(m[:, b] + right[b]) - held[:, b]).sum(1)
    same = np.diag(m)
    gain -= _f(same + left) + _f(same + right) - 2 * _f(same)  # a class's bigram with itself grows by both sides at once
    gain += _f(same + left + right + self_count) - _f(same)
    # whatever the class, the word follows and is followed as often, so those bigrams count in the sums of the others
    for total, more in ((m.sum(1) + left, after.sum()), (m.sum(0) + right, before.sum())):
        gain -= _f(total + more) - _f(total)
    gain[:fixed] = -np.inf
    best = int(np.argmax(gain))
    return best, float(gain[best] - gain[own])


def move(m: np.ndarray, before: np.ndarray, after: np.ndarray, own: int, to: int, self_count: float) -> None:
    """Takes a word's bigrams out of its own class and puts them into another, in m."""
    for c, sign in ((own, -1), (to, 1)):
        m[:, c] += sign * before
        m[c, :] += sign * after
        m[c, c] -= sign * self_count
        if c == own:  # from now on the word stands beside itself in the other class
            before[own] -= self_count
            after[own] -= self_count
            before[to] += self_count
            after[to] += self_count


def likelihood(m: np.ndarray) -> float:
    """The part of the log likelihood of class bigrams that depends on the classes."""
    return float(_f(m).sum() - _f(m.sum(0)).sum() - _f(m.sum(1)).sum())


def _side(cell, classes: np.ndarray, k: int, node: int) -> tuple[np.ndarray, int]:
    """Counts by class of a node's neighbours on one side, and of itself among them."""
    if not cell.is_valid:
        return np.zeros(k, np.int64), 0
    other, n = (cell.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    return np.bincount(classes[other], n, k).astype(np.int64), int(n[other == node].sum())


def class_bigrams(near: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """k by k counts of class bigrams; no more than their number reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((k, k), np.int64)
        for batch in batches:
            for node, after in zip(batch.column("node").to_pylist(), batch.column("after")):
                m[classes[node]] += _side(after, classes, k, node)[0]
        code = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(m.ravel()[code])], ["code", "n"])

    out = np.zeros(k * k, np.int64)
    for r in near.select("node", "after").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out.reshape(k, k)


def exchange(near: DataFrame, n_core: int, n_nodes: int, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The class of each node (0 for the end of a text alone), the counts of class bigrams, and the likelihood of each round."""
    classes = np.arange(n_nodes) % max(k - 1, 1) + 1
    classes[1:n_core] = np.arange(n_core - 1) % max(k - 1, 1) + 1  # by frequency: the first of them get classes of their own
    classes[0] = 0
    best, told, turns = (-math.inf, classes, None), [], 0
    for turn in range(rounds + 1):
        m = class_bigrams(near, classes, k)
        told.append(likelihood(m))
        if told[-1] > best[0]:
            turns = 0 if told[-1] > best[0] + 1e-4 * abs(best[0]) else turns + 1
            best = (told[-1], classes, m)
        else:
            turns += 1
        if turn == rounds or turns == 4 or k < 3:
            break

        m = m.astype(float)

        def run(batches: Iterator[pa.RecordBatch], m=m, classes=classes, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for node, after, before in zip(batch.column("node").to_pylist(), batch.column("after"), batch.column("before")):
                    if node and (node * 2654435761 >> 16) % 2 == turn % 2:
                        (right, same), (left, _) = _side(after, classes, k, node), _side(before, classes, k, node)
                        gain = best_class(m, left, right, int(classes[node]), same)[1]
                        if gain > 1e-6:
                            found.append((node, gain, same, left.tolist(), right.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], ["node", "gain", "same", "before", "after"])

        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        classes = classes.copy()
        proposed = near.mapInArrow(run, "node long, gain double, same long, before array<long>, after array<long>").collect()  # at most a row for each node
        for r in sorted(proposed, key=lambda r: (-r.gain, r.node)):
            left, right, own = np.array(r.before), np.array(r.after), int(classes[r.node])
            to, gain = best_class(m, left, right, own, r.same)
            if gain > 1e-6:
                classes[r.node] = to
                move(m, left.astype(float), right.astype(float), own, to, r.same)
    return best[1], best[2], told


class ClassModel:
    """What a task needs to score: all of it of a size that parameters set."""

    def __init__(self, core: dict[bytes, int], endings: int, classes: np.ndarray, m: np.ndarray, words: np.ndarray, discount: float, total: int, distinct: int):
        self.core, self.endings, self.classes, self.discount, self.total, self.distinct = core, endings, classes, discount, total, distinct
        tokens = m.sum(0).astype(float)  # every token stands after one other
        share = tokens / max(total, 1)
        self.transition = (m + PRIOR * share) / (m.sum(1, keepdims=True) + PRIOR) if total else np.zeros(m.shape)
        self.tokens = np.maximum(tokens, 1.0)
        self.unknown = discount * words / self.tokens
        self.base_of = lambda n: (n + BASE) / (total + BASE * (distinct + 1))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "base_of"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.base_of = lambda n: (n + BASE) / (self.total + BASE * (self.distinct + 1))

    def probabilities(self, classes: np.ndarray, before: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of tokens with counts n, by their class and the class before."""
        known = n > 0
        emission = np.where(known, (n - self.discount) / self.tokens[classes], self.unknown[classes])
        # an unknown word has a class, so base's one unknown word is shared among the classes
        return MIX * self.transition[before, classes] * emission + (1 - MIX) * self.base_of(n) / np.where(known, 1, len(self.tokens))


def learn(found: DataFrame, vocabulary: DataFrame, k: int = CLASSES, core: int = CORE, endings: int = ENDINGS, rounds: int = ROUNDS) -> ClassModel:
    """Classes and counts from the training texts of blocks and the table of their words."""
    words = core_words(vocabulary, core)
    n_nodes = len(words) + endings
    near = neighbours(found, words, endings)
    classes, m, _ = exchange(near, len(words), n_nodes, k, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, distinct, few, total = unship(shared), np.zeros(k, np.int64), np.zeros(3, np.int64), 0
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            distinct += np.bincount(classes[nodes_of(batch.column("word").to_pylist(), own, endings)], minlength=k)
            few += [(n == 1).sum(), (n == 2).sum(), n.sum()]
        held = np.concatenate([distinct, few])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 3)), pa.array(held)], ["code", "n"])

    shared = ship(found.sparkSession, words)
    held = np.zeros(k + 3, np.int64)
    for r in vocabulary.mapInArrow(released(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        held[r.code] = r.n
    once, twice, total = held[k:].tolist()
    return ClassModel(words, endings, classes, m, held[:k], once / (once + 2 * twice) if once else 0.5, total, int(held[:k].sum()))


def score(docs: DataFrame, k: int = CLASSES, core: int = CORE, endings: int = ENDINGS, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    found = materialise(blocks(docs, block_bytes), "brown-blocks", rows_a_file=1)
    each = found.select(F.explode(F.arrays_zip("words", "seen")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.seen").alias("n"))
    vocabulary = materialise(each.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "brown-words")
    model = ship(spark, learn(found, vocabulary, k, core, endings, rounds))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = unship(model)
        out = []
        for row in map(_arrays, _rows(left.to_batches())):
            n = np.zeros(len(row["words"]), np.int64)
            n[right.column("at").to_numpy()] = right.column("n").to_numpy()
            classes = own.classes[nodes_of(row["words"].to_pylist(), own.core, own.endings)]
            tokens, before, _ = _tokens(row)
            times, starts = n[tokens], np.cumsum(row["sizes"]) - row["sizes"]
            sums = [np.add.reduceat(x, starts) for x in (times > 0, np.log10(own.base_of(times)), np.log10(own.probabilities(classes[tokens], classes[before], times)))]
            columns = [pa.array(row["doc_ids"], pa.int64(), from_pandas=True), pa.array(row["held"], pa.bool_()), pa.array(row["sizes"], pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(starts), own.total, np.int64)), *map(pa.array, sums[1:])]
            out.append(pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.Table.from_batches(out)

    placed = found.select("block", F.posexplode("words").alias("at", "word")).join(vocabulary, "word").select(F.col("block").alias("of"), "at", "n")
    # about one block for each task, so that a task reads as much however many blocks there are
    parts = max(found.select("block").count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return found.drop("seen").repartition(parts, "block").groupBy("block").cogroup(placed.repartition(parts, "of").groupBy("of")).applyInArrow(run, SCORES)


def op13_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
