"""Toxicity by gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

A lexicon is learned from labelled rows: words, and beginnings of words, that stand in far more toxic
texts than others. Beside its densities the trees see how near its words stand to a second person, how
much is in capitals, punctuation and disguised spellings (digits or signs for letters, drawn-out letters).

Learning takes every labelled row outside the held-out fold. Their features become bins, whose ends are quantiles of all rows'
values (in cells of a 128th of an octave), and each level of the trees is a pass over the bins: a task sums gradients
over nodes, features and bins, and the driver adds the sums of the tasks, of which there are as many as cores. The calibration
sees the rows in PARTS parts, each scored by a lexicon and trees that have learned from the other parts alone, and counts them by
margin (in steps of MARGIN_STEP). So the driver holds counts by word, cell, bin and margin, but no rows. Scores see nothing but the
text. Scoring reads every whole text.

Cases: null text counts as empty and gets the score of an empty text. Labels that are null or not 0 or 1,
and labels of null ids, teach nothing; of several labels for one id the largest counts. Repeated rows get
equal scores. With no toxic or no other row to learn from the score is the share of toxic rows (0 with no
labels at all). Extra columns are ignored by scores and carried through by keep_clean. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BINS, BoostedTrees, Isotonic
from .common import give_back, held_out, materialise, read_table, released, ship, sized_broadcast, unship, whole_text

THRESHOLD, PARTS, TREES = 0.3, 5, 40
#: Beginnings of words that the lexicon considers, in letters.
STEMS = range(4, 10)
LEXICON_SIZE, LEAST_WEIGHT = 4000, 2.0
MEMO_ENTRIES = 150_000
#: One in so many clean rows is counted first.
FIRST = 6
#: Low bits of a feature's float that its cell leaves out, rows of features in a block, terms that a task counts before it passes them on.
CELL_BITS, BLOCK_ROWS, COUNTED = 16, 4096, 100_000
#: Margins are counted in such steps for the calibration.
MARGIN_STEP = 2.0**-8

#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo tus usted ustedes vosotros os".split())
#: Signs and digits commonly put for letters.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

EDGE = ".,;:!?\"'()[]{}<>*#%&|-_…«»“”„"
PUNCTUATION, CAPITALS = re.compile(r"[^\w\s]"), re.compile(r"[A-ZÀ-ÖØ-Þ]")
DRAWN, SHOUT, DIGIT = re.compile(r"(\w)\1{2,}"), re.compile(r"!"), re.compile(r"\d")
DISGUISED = re.compile(r"[^\W\d_][0-9@$!*]+[^\W\d_]")
#: Of a character, a bit for each pattern that it matches.
KINDS = (CAPITALS, PUNCTUATION, DIGIT, re.compile(r"\w"), re.compile(r"[^\W\d_]"), re.compile(r"[0-9@$!*]"))
CAPITAL, SIGN, FIGURE, WORD, LETTER, VEIL = (1 << k for k in range(len(KINDS)))
UNSEEN = 255


def terms(word: str) -> list[str]:
    """The word in its plain spelling and its beginnings, the latter marked by a closing ~."""
    return [word, *(word[:k] + "~" for k in STEMS if len(word) > k)]


def plain(token: str) -> str:
    word = token.lower().strip(EDGE)
    if word and not word.isalpha() and DISGUISED.search(word):
        word = DRAWN.sub(r"\1", word.translate(DISGUISE).replace("*", ""))
    return word


class Heads(dict):
    """For the first letters of a token, whether what plain makes of it may be a word, or begin with a beginning of words, of those given.

    Most tokens of a large corpus are rare, so a memo of tokens misses them over and over; their first letters are few.
    """

    def __init__(self, begins: Iterable[str], capitals: bool = False):
        """begins: terms or words; capitals: tokens that may be all in capitals count too."""
        super().__init__()
        self.begins, self.capitals = {t[: STEMS.start].removesuffix("~") for t in begins}, capitals

    def __missing__(self, head: str) -> bool:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        low = head.lower()
        # plain leaves such a beginning as it is: only letters, none drawn out here or by what follows, and no capital sigma, whose small letter hangs on what follows
        fixed = len(head) == len(low) == STEMS.start and low.isalpha() and low[-1] != low[-2] and not DRAWN.search(low) and "Σ" not in head
        found = self[head] = not fixed or low in self.begins or self.capitals and f"{head}A".isupper()
        return found


class Terms:
    """Finds the terms of texts, of those in keep if that is given."""

    def __init__(self, keep: Iterable[str] | None = None):
        self.memo: dict[str, tuple[str, ...]] = {}
        self.dull: set[str] = set()  # tokens without a term
        self.keep = None if keep is None else frozenset(keep)
        self.heads = None if keep is None else Heads(self.keep)
        self.begins = {t.removesuffix("~")[:k] for t in self.keep or () for k in STEMS}

    def of_word(self, word: str) -> tuple[str, ...]:
        if self.keep is None:
            return tuple(terms(word)) if word else ()
        out = [word] if word in self.keep else []
        for k in STEMS:
            if len(word) <= k or word[:k] not in self.begins:  # nor does a term begin with more of the word
                break
            if (stem := word[:k] + "~") in self.keep:
                out.append(stem)
        return tuple(out)

    def of(self, text: str) -> set[str]:
        memo, dull, heads = self.memo, self.dull, self.heads
        if len(memo) + len(dull) >= MEMO_ENTRIES:
            memo.clear()
            dull.clear()
        rest = set(text.split()).difference(dull)
        out: set[str] = set()
        for token in rest if heads is None else [t for t in rest if heads[t[: STEMS.start]]]:
            own = memo.get(token)
            if own is None and (own := self.of_word(plain(token))):
                memo[token] = own
            if own:
                out.update(own)
        dull.update(rest.difference(memo))
        return out


def _document_counts(rows: DataFrame, keep: frozenset | None) -> DataFrame:
    """term, n: in how many texts of each part a term stands, of those in keep if that is given. Counts are summed for each task before the shuffle."""
    spark = rows.sparkSession
    shared = None if keep is None else spark.sparkContext.broadcast(keep)

    def told(found: list[Counter[str]]) -> pd.DataFrame:
        held = list(set().union(*found))
        return pd.DataFrame({"term": pd.Series(held, dtype=object)} | {f"n{k}": np.fromiter(map(own.get, held, repeat(0)), np.int64, len(held)) for k, own in enumerate(found)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Terms(None if shared is None else shared.value)
        found: list[Counter[str]] = [Counter() for _ in range(PARTS)]
        for batch in batches:
            for text, part in zip(batch.text, batch.part):
                found[part].update(find.of(text))
            if sum(map(len, found)) > 2 * COUNTED:  # a common term stands in each part's counts
                yield told(found)
                found = [Counter() for _ in range(PARTS)]
        yield told(found)

    names = [f"n{k}" for k in range(PARTS)]
    counted = rows.select("text", "part").mapInPandas(released(run), "term string, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy("term").agg(*[F.sum(n).alias(n) for n in names])


def _weights(in_toxic: dict[str, int], in_clean: dict[str, int], toxic: int, clean: int) -> dict[str, float]:
    """Term to log odds. Only terms in at least a two-hundredth of the toxic texts (3 at least) are looked at, LEXICON_SIZE of them at most are kept."""
    least = max(3, toxic // 200)
    weight = {t: float(np.log((n + 0.5) / (toxic + 1)) - np.log((in_clean.get(t, 0) + 0.5) / (clean + 1))) for t, n in in_toxic.items() if n >= least}
    best = sorted((t for t in weight if weight[t] >= LEAST_WEIGHT), key=lambda t: (-weight[t] * in_toxic[t], t))[:LEXICON_SIZE]
    return {t: weight[t] for t in best}


def _hopeful(in_toxic: dict[str, np.ndarray], in_clean: dict[str, np.ndarray], toxic: np.ndarray, clean: np.ndarray, uses: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Those of in_toxic that with so many clean texts, or more, may have LEAST_WEIGHT in a lexicon; each learns from the parts in one of uses."""
    none = np.zeros(PARTS, np.int64)
    n, c = (np.array([counts.get(t, none) for t in in_toxic], np.int64).reshape(-1, PARTS) for counts in (in_toxic, in_clean))
    odds = [np.log((n[:, use].sum(1) + 0.5) / (toxic[use].sum() + 1)) - np.log((c[:, use].sum(1) + 0.5) / (clean[use].sum() + 1)) for use in uses]
    return {t: in_toxic[t] for t, most in zip(in_toxic, np.max(odds, 0)) if most > LEAST_WEIGHT - 1e-6}


def learn_lexicons(sample: DataFrame, toxic: list[int], clean: list[int]) -> list[dict[str, float]]:
    """The lexicon of the whole sample, then for each part that of all other parts. toxic and clean: rows of each part."""
    n = sum((F.col(f"n{k}") for k in range(PARTS)), F.lit(0))
    often = _document_counts(sample.where("toxic = 1"), None).where(n >= max(3, (sum(toxic) - max(toxic)) // 200)).orderBy(F.desc(n), "term").limit(20 * LEXICON_SIZE)
    in_toxic = {r.term: np.array(r[1:]) for r in often.collect()}
    toxic, clean = np.array(toxic), np.array(clean)
    uses = [np.arange(PARTS) != k for k in (PARTS, *range(PARTS))]
    in_clean: dict[str, np.ndarray] = {}
    first = F.pmod(F.xxhash64("text"), F.lit(FIRST)) == 0
    for rows in (first, ~first):  # counts only grow, so a term that the first rows show to be too common needs no more counting
        for r in _document_counts(sample.where("toxic = 0").where(rows), frozenset(in_toxic)).collect():
            in_clean[r.term] = in_clean.get(r.term, 0) + np.array(r[1:])
        in_toxic = _hopeful(in_toxic, in_clean, toxic, clean, uses)
    out = []
    for use in uses:
        own = lambda counts, use=use: {t: int(c[use].sum()) for t, c in counts.items()}
        out.append(_weights(own(in_toxic), own(in_clean), int(toxic[use].sum()), int(clean[use].sum())))
    return out


class Features:
    """Dense features of one text; those of the lexicon for each of several lexicons."""

    names = ("words", "hits", "hit_density", "weight_density", "top_weight", "second_hit_weight", "distinct_hits", "near_second", "second_density", "capitals", "all_caps", "shouts", "punctuation", "drawn", "disguised", "digits", "distinct", "word_length")

    def __init__(self, *lexicons: dict[str, float]):
        self.lexicons, self.terms = lexicons, Terms(t for x in lexicons for t in x)
        self.begins = self.terms.heads.begins  # no word that begins otherwise has a weight
        self.heads = Heads((*self.begins, *SECOND_PERSON), capitals=True)
        self.memo: dict[str, tuple[tuple[float, ...], bool]] = {}  # what tell gives of a token
        self.dull: set[str] = set()  # tokens that tell leaves out
        self.kinds = np.full(0x110000, UNSEEN, np.uint8)

    def weigh(self, token: str) -> tuple[float, ...]:
        """The token's weight in each lexicon; -1 for a second person; empty if it is neither."""
        word = plain(token)
        own = self.terms.of_word(word) if word[: STEMS.start] in self.begins else ()
        found = tuple([max([x.get(t, 0.0) for t in own]) for x in self.lexicons]) if own else ()
        if word in SECOND_PERSON:
            found = tuple(w or -1.0 for w in found or (0.0,) * len(self.lexicons))
        return found

    def tell(self, kinds: set[str]) -> dict[str, tuple[tuple[float, ...], bool]]:
        """Of those tokens that have a mark or are all in capitals: what weigh says, and whether they are."""
        memo, dull, heads = self.memo, self.dull, self.heads
        if len(memo) + len(dull) >= MEMO_ENTRIES:
            memo.clear()
            dull.clear()
        rest = kinds.difference(dull)
        out = {}
        for token in [t for t in rest if heads[t[: STEMS.start]]]:
            found = memo.get(token)
            if found is None:
                found = self.weigh(token), token.isupper() and len(token) > 2
                if not any(found):
                    continue
                memo[token] = found
            out[token] = found
        dull.update(rest.difference(out))
        return out

    def counts(self, text: str) -> tuple[int, ...]:
        """How often CAPITALS, SHOUT, PUNCTUATION, DRAWN, DISGUISED and DIGIT are found, by the kinds of all characters at once."""
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[chars]
        if (new := kinds == UNSEEN).any():
            for c in np.unique(chars[new]).tolist():
                self.kinds[c] = sum(1 << k for k, p in enumerate(KINDS) if p.match(chr(c)))
            kinds = self.kinds[chars]
        count = lambda kind: int(np.count_nonzero(kinds & kind))
        same = chars[1:] == chars[:-1]
        third = same[1:] & same[:-1] & (kinds[2:] & WORD > 0)
        drawn = int(np.count_nonzero(third[:1]) + np.count_nonzero(third[1:] > third[:-1]))
        left, right = kinds[:-1], kinds[1:]
        veiled = ((left & LETTER > 0) & (right & VEIL > 0)).any() and ((left & VEIL > 0) & (right & LETTER > 0)).any()
        return count(CAPITAL), text.count("!"), count(SIGN), drawn, len(DISGUISED.findall(text)) if veiled else 0, count(FIGURE)

    def of(self, text: str) -> tuple[float, ...]:
        return self.each(text)[0]

    def each(self, text: str) -> list[tuple[float, ...]]:
        tokens = text.split()
        n, chars, kinds = len(tokens), len(text), set(tokens)
        told = self.tell(kinds)
        marks = {t: w for t, (w, _) in told.items() if w}
        places = [i for i, t in enumerate(tokens) if t in marks] if marks else []
        held = [marks[tokens[i]] for i in places]
        per, by = 1.0 / max(n, 1), 1.0 / max(chars, 1)
        capitals, shouts, punctuation, drawn, disguised, digits = self.counts(text)
        first = float(np.log1p(n))
        last = (capitals * by, sum([shout for _, shout in told.values()]) * per, shouts * by, punctuation * by, drawn * per, disguised * per, digits * by, len(kinds) * per, chars * per)
        out = []
        for k in range(len(self.lexicons)):
            hits, you = [i for i, w in zip(places, held) if w[k] > 0], [i for i, w in zip(places, held) if w[k] < 0]
            weights = sorted((w[k] for w in marks.values() if w[k] > 0), reverse=True)
            near = 0
            if hits and you:
                at = np.searchsorted(you, hits)
                left = np.array(hits) - np.array([-99, *you])[at]
                right = np.array([*you, n + 99])[at] - np.array(hits)
                near = int((np.minimum(left, right) <= 6).sum())
            total = sum([w[k] for w in held if w[k] > 0])
            out.append((first, float(len(hits)), len(hits) * per, total * per, weights[0] if weights else 0.0, weights[1] if len(weights) > 1 else 0.0, float(len(weights)), near * per, len(you) * per, *last))
        return out


class ToxicityModel:
    """What executors score with: lexicon, trees and calibration; its size is bounded by LEXICON_SIZE and the trees."""

    def __init__(self, lexicon, trees=None, calibrate=None, share: float = 0.0):
        self.lexicon, self.trees, self.calibrate, self.share = lexicon, trees, calibrate, share

    def scorer(self):
        features = Features(self.lexicon)

        def score(texts: list[str]) -> np.ndarray:
            if self.trees is None:
                return np.full(len(texts), self.share)
            if not len(texts):
                return np.zeros(0)
            return self.calibrate(self.trees.margin(np.array([features.of(t) for t in texts])))

        return score


def _feature_blocks(sample: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """toxic, part and x of up to BLOCK_ROWS rows each, as bytes; x: the features for each lexicon."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, held = Features(*shared.value), []

        def block() -> pd.DataFrame:
            toxic, part, x = zip(*held)
            return pd.DataFrame({"toxic": [np.array(toxic, np.uint8).tobytes()], "part": [np.array(part, np.uint8).tobytes()], "x": [np.array(x, np.float32).tobytes()]})

        for batch in batches:
            for toxic, part, text in zip(batch.toxic, batch.part, batch.text):
                held.append((toxic, part, np.concatenate(features.each(text))))
                if len(held) == BLOCK_ROWS:
                    yield block()
                    held.clear()
        if held:
            yield block()

    return materialise(sample.mapInPandas(released(run), "toxic binary, part binary, x binary"), "toxicity-features", 1)


def _rows(blocks: Iterator[tuple[bytes, bytes, bytes]], kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """toxic, part and features (or bins) of each block, the latter by row, lexicon and feature."""
    for toxic, part, x in blocks:
        toxic = np.frombuffer(toxic, np.uint8)
        yield toxic, np.frombuffer(part, np.uint8), np.frombuffer(x, kind).reshape(len(toxic), 1 + PARTS, -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, bytes]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _learns(part: np.ndarray, k: int) -> np.ndarray:
    """Which rows the model k learns from: all for 0, else those of the other parts than k - 1."""
    return part != k - 1 if k else np.ones(len(part), bool)


def _edges(blocks: DataFrame) -> list[list[np.ndarray]]:
    """For each model the ends of its features' bins: quantiles of the rows it learns from, rounded up to the end of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for _, part, x in _rows(_blocks(batches), np.float32):
            cells = np.ascontiguousarray(x).view(np.int32) >> CELL_BITS  # floats from zero on are in the order of their bits
            for k in range(1 + PARTS):
                own = cells[_learns(part, k), k]
                key = ((k * own.shape[1] + np.arange(own.shape[1])) << 32 - CELL_BITS) + own
                for c, n in zip(*(v.tolist() for v in np.unique(key, return_counts=True))):
                    found[c] = found.get(c, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["cell", "n"])

    counted = blocks.mapInArrow(released(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
    cell, n = counted["cell"].to_numpy(), counted["n"].to_numpy()
    column, f = cell >> 32 - CELL_BITS, len(Features.names)
    out = []
    for k in range(1 + PARTS):
        own = []
        for j in range(f):
            lo, hi = np.searchsorted(column, [k * f + j, k * f + j + 1])
            upto = n[lo:hi].cumsum()
            at = np.searchsorted(upto, upto[-1:] * np.arange(1, BINS) / BINS) if hi > lo else np.zeros(0, int)
            value = (cell[lo:hi][np.unique(at)] & (1 << 32 - CELL_BITS) - 1) + 1 << CELL_BITS
            own.append((value - 1).astype(np.int32).view(np.float32))
        out.append(own)
    return out


def _binned(blocks: DataFrame, models: list[BoostedTrees | None]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, part, x in _rows(_blocks(batches), np.float32):
            bins = np.stack([np.zeros(x[:, k].shape, np.uint8) if m is None else m.bins(x[:, k]) for k, m in enumerate(models)], 1)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (toxic, part, bins)], ["toxic", "part", "bins"])

    return materialise(blocks.mapInArrow(released(run), "toxic binary, part binary, bins binary"), "toxicity-bins")


def _grow(bins: RDD, models: list[BoostedTrees | None]) -> None:
    """The next level of all models; bins: the rows of _binned."""

    def run(blocks: Iterator[tuple[bytes, bytes, bytes]]) -> Iterator[list]:
        total: list = [0.0] * len(models)
        for toxic, part, x in _rows(blocks, np.uint8):
            for k, model in enumerate(models):
                if model is not None:
                    own = _learns(part, k)
                    total[k] = total[k] + model.sums(x[own, k], toxic[own].astype(float))
        yield total

    found = bins.mapPartitions(run).collect()  # of each task the sums for each model
    for k, model in enumerate(models):
        if model is not None:
            model.grow(sum(own[k] for own in found))


def _calibrate(bins: DataFrame, models: list[BoostedTrees | None]) -> Isotonic:
    """From the margins of rows by models that have not learned from them; by the model of all rows if there are no others."""
    others = any(m is not None for m in models[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, part, x in _rows(_blocks(batches), np.uint8):
            for k, model in enumerate(models):
                own = ~_learns(part, k) if others else np.full(len(part), k == 0)
                if model is not None and own.any():
                    step = np.rint(model.margin_of(x[own, k]) / MARGIN_STEP).astype(np.int64)
                    at, where, n = np.unique(step, return_inverse=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(where, toxic[own]).astype(np.int64)), pa.array(n)], ["step", "toxic", "n"])

    counted = bins.mapInArrow(released(run), "step long, toxic long, n long").groupBy("step").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).toArrow()
    return Isotonic().fit(counted["step"].to_numpy() * MARGIN_STEP, counted["toxic"].to_numpy(), counted["n"].to_numpy())


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    spark = docs.sparkSession
    known = materialise(labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "toxicity-labels")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int")
    texts = docs.select("doc_id", whole_text().alias("text")).join(sized_broadcast(known), "doc_id").select("text", "toxic", part.alias("part"))
    sample = materialise(texts, "toxicity-sample")
    n = {(r.toxic, r.part): r.n for r in sample.groupBy("toxic", "part").agg(F.count("*").alias("n")).collect()}
    toxic, clean = ([n.get((label, k), 0) for k in range(PARTS)] for label in (1, 0))
    if not sum(toxic) or not sum(clean):
        return ToxicityModel({}, share=float(sum(toxic) > 0))
    lexicons = learn_lexicons(sample, toxic, clean)
    blocks = _feature_blocks(sample, lexicons)
    models: list[BoostedTrees | None] = []
    for k, edges in enumerate(_edges(blocks)):
        ones, zeros = (sum(v) - (v[k - 1] if k else 0) for v in (toxic, clean))
        models.append(BoostedTrees(trees=TREES).start(edges, ones / (ones + zeros)) if ones and zeros else None)
    bins = _binned(blocks, models).coalesce(spark.sparkContext.defaultParallelism)
    rows = bins.rdd  # many passes, so no query is planned for each
    for _ in range(TREES * models[0].depth):
        _grow(rows, models)
    calibrate = _calibrate(bins, models)
    give_back()
    return ToxicityModel(lexicons[0], models[0], calibrate)


def scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score of every row."""
    shared = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = unship(shared).scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score(part.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(released(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under threshold; labelled holds the texts to learn from, docs itself if not given."""
    shared = ship(docs.sparkSession, learn(docs if labelled is None else labelled, labels))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = unship(shared).scorer()
        for texts in batches:
            yield pd.Series(np.concatenate([own(texts[at : at + 512].tolist()) for at in range(0, len(texts), 512)] or [np.zeros(0)]))

    return docs.where(score(whole_text()) < threshold)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = scores(docs, learn(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
