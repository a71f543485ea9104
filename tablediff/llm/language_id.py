"""Language identification in two levels: first the family, then the languages within it.

Features are hashed letter n-grams (one to three letters, words set apart by a space). A linear support
vector machine for each family, one against the rest, picks the family; within it one machine for each pair
of languages votes. Families are a fixed table of closely related languages; a language that it does not
list is a family of its own.

Learning takes a bounded sample of documents with a language, TRAIN_ROWS at most for each language, in the order of
a hash of the id, outside the held-out fold. Every whole text is predicted from its letters alone.

Cases: text that is null or has no letter is und with score 0. With no language to learn from everything is
und; with one, every text with a letter has it. Repeated rows get equal results, null ids are kept. Ties go
to the language that sorts first. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import give_back, held_out, read_table, released, ship, unship, whole_text

TRAIN_ROWS = 1500
WIDTH_BITS = 15
#: Code points whose n-grams are held in memory at once.
BLOCK = 1 << 19

#: Families of closely related languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "da", "sv", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "finnic": ("fi", "et"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu"),
    "turkic": ("tr", "az", "kk", "uz"),
}


def family(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def letters(text: str) -> np.ndarray:
    """Lower-case code points with every run of other characters as one space, and a space at both ends; empty without letters."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower().translate(_ASCII)
    words = kept.split()
    return np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64) if words else np.zeros(0, np.uint64)


_ASCII = {c: " " for c in range(128) if not chr(c).isalpha()}


def grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text's code points, in blocks."""
    shift = np.uint64(64 - WIDTH_BITS)
    for at in range(0, len(points), BLOCK):
        p = points[max(0, at - 2) : at + BLOCK]
        skip = min(at, 2)
        one = p * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (p[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93)
        three = (two[:-1] ^ (p[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xD6E8FEB86659FD93)
        yield np.concatenate([((one ^ (one >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))[skip:] >> shift, two[max(0, skip - 1) :] >> shift, three >> shift]).astype(np.int64)


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins and square roots of shares, of length one."""
    counts = np.zeros(1 << WIDTH_BITS)
    for g in grams(letters(text)):
        counts += np.bincount(g, minlength=1 << WIDTH_BITS)
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at] / max(counts.sum(), 1))


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, passes: int = 6, cost: float = 4.0) -> np.ndarray:
    """Weights of a linear support vector machine by dual coordinate descent, the last one the bias."""
    w, alpha = np.zeros((1 << WIDTH_BITS) + 1), np.zeros(len(y))
    rng = np.random.default_rng(11)
    weight = cost * len(y) / (2 * np.array([max((y == s).sum(), 1) for s in np.sign(y)]))
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), weight[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                w[-1] += step
            alpha[i] = new
    return w


class LanguageModel:
    """Family machines and pair machines as columns of one matrix; at most 2**WIDTH_BITS rows and a column for each."""

    def __init__(self, rows, langs: list[str]):
        self.langs = sorted(set(langs))
        lang = np.array(langs, object)
        of = np.array([family(x) for x in langs], object)
        self.families = sorted(set(of))
        self.members = {f: [x for x in self.langs if family(x) == f] for f in self.families}
        columns, self.pairs = [], []
        if len(self.families) > 1:
            for f in self.families:
                columns.append(train_svm(rows, np.where(of == f, 1.0, -1.0)))
        for f in self.families:
            m = self.members[f]
            for i, a in enumerate(m):
                for b in m[i + 1 :]:
                    own = np.flatnonzero((lang == a) | (lang == b))
                    columns.append(train_svm([rows[k] for k in own], np.where(lang[own] == a, 1.0, -1.0)))
                    self.pairs.append((a, b))
        self.w = np.stack(columns, 1).astype(np.float32) if columns else np.zeros(((1 << WIDTH_BITS) + 1, 0), np.float32)

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs:
            return "und", 0.0
        points = letters(text)
        if not len(points):
            return "und", 0.0
        counts = np.zeros(1 << WIDTH_BITS)
        for g in grams(points):
            counts += np.bincount(g, minlength=1 << WIDTH_BITS)
        at = np.flatnonzero(counts)
        margin = np.sqrt(counts[at] / counts.sum()) @ self.w[at] + self.w[-1]
        sure = lambda m: 1 / (1 + float(np.exp(-2 * min(max(m, -30.0), 30.0))))
        k = len(self.families) if len(self.families) > 1 else 0
        best = int(np.argmax(margin[:k])) if k else 0
        score = sure(margin[best]) if k else 1.0
        own = self.members[self.families[best]]
        votes, sums = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
        for (a, b), m in zip(self.pairs, margin[k:]):
            if a in votes:
                winner = a if m >= 0 else b
                votes[winner] += 1
                sums[winner] += abs(float(m))
        lang = min(own, key=lambda x: (-votes[x], -sums[x], x))
        if len(own) > 1:
            score *= sure(sums[lang] / max(votes[lang], 1))
        return lang, score


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel:
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # ids are taken by a rank on narrow rows that a hash has thinned to a bounded number for each language
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], [])
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, 3 * rows / n) * 1_000_000))])
    thinned = known.select("doc_id", "lang", h.alias("h")).where(F.col("h") < share[F.col("lang")])
    chosen = thinned.withColumn("k", F.row_number().over(first)).where(F.col("k") <= rows).select("doc_id", "lang").distinct()
    texts = docs.select("doc_id", "lang", whole_text().alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [profile(t) for t in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id, "lang": batch.lang, "at": [a.astype(np.int32) for a, _ in found], "v": [v.astype(np.float32) for _, v in found]})

    sample = texts.mapInPandas(released(run), "doc_id long, lang string, at array<int>, v array<float>").where("size(at) > 0").toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    # one array for all rows, cut at their ends: lists of numbers would take several times as much
    profiles = [(np.asarray(a.values), np.asarray(v.values)) for a, v in zip(sample["at"], sample["v"])]
    model = LanguageModel(profiles, sample["lang"].to_pylist())
    del sample, profiles
    give_back()
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unship(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [own.predict(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(released(run), "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
