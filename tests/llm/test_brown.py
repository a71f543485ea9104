import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tablediff.llm import brown as B

SCHEMA = "doc_id long, text string, n string, score int"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", lower)] + [b""]


def corpus(n=160):
    rng = random.Random(3)
    kinds = [("red blue green".split(), "cat dog bird".split(), "runs sleeps".split()), ("rot blau grün".split(), "Katze Hund Vogel".split(), "läuft schläft".split())]
    docs = []
    for i in range(n):
        adjective, noun, verb = kinds[i % 2]
        docs.append((i, " ".join(f"{rng.choice(adjective)} {rng.choice(noun)}\t{rng.choice(verb)} w{rng.randrange(400)}" for _ in range(rng.randrange(12)))))
    return docs + [(1000, None), (1000, None), (1001, ""), (None, "red cat sleeps"), (7, docs[7][1]), (1002, "red blue " * 3000), (1003, "\xa0 \x1c 　x")]


def brute(docs, model):
    """Scores from counts made here and the model's classes alone."""
    train = [t for i, text in docs if not held(i) for t in tokens(text)]
    count, total = Counter(train), len(train)
    node = lambda w: model.core[w] if w in model.core else len(model.core) + zlib.crc32(w[-3:]) % model.endings
    cls = lambda w: int(model.classes[node(w)])
    k = len(model.tokens)
    in_class, distinct = Counter(map(cls, train)), Counter(map(cls, count))
    pair, first = Counter(), Counter()
    for i, text in docs:
        if not held(i):
            own = tokens(text)
            for v, w in zip([b"", *own], own):
                pair[cls(v), cls(w)] += 1
                first[cls(v)] += 1
    once, twice = (sum(n == x for n in count.values()) for x in (1, 2))
    d = once / (once + 2 * twice) if once else 0.5
    base = lambda w: (count[w] + 0.1) / (total + 0.1 * (len(count) + 1))

    def p(v, w):
        t = (pair[cls(v), cls(w)] + B.PRIOR * in_class[cls(w)] / total) / (first[cls(v)] + B.PRIOR)
        e = (count[w] - d if count[w] else d * distinct[cls(w)]) / max(in_class[cls(w)], 1)
        return B.MIX * t * e + (1 - B.MIX) * base(w) / (1 if count[w] else k)

    rows = []
    for i, text in docs:
        own = tokens(text)
        rows.append((i, held(i), len(own), sum(count[w] > 0 for w in own), total, sum(math.log10(base(w)) for w in own), sum(math.log10(p(v, w)) for v, w in zip([b"", *own], own))))
    return rows, p, count


def same(a, b):
    key = lambda r: (str(r[0]), r[2], r[6])
    a, b = sorted(a, key=key), sorted(b, key=key)
    return len(a) == len(b) and all(x[:5] == y[:5] and x[5] == pytest.approx(y[5], rel=1e-9) and x[6] == pytest.approx(y[6], rel=1e-9) for x, y in zip(a, b))


@pytest.mark.parametrize("block_bytes", [B.BLOCK_BYTES, 300])
def test_equals_brute_force(spark, block_bytes, monkeypatch):
    docs, seen = corpus(), []
    learn = B.learn
    monkeypatch.setattr(B, "learn", lambda *a: seen.append(learn(*a)) or seen[-1])
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA).repartition(3)
    got = B.score(df, 8, 16, 16, 6, block_bytes)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want, p, count = brute(docs, seen[0])
    assert same([tuple(r) for r in got.collect()], want)
    # what may follow a word sums to one: known words, and an unknown one of each class
    for v in (b"red", b"", b"w1", b"never"):
        unknown, k = {}, 8
        for i in range(5000):
            w = f"unseen{i}".encode()
            unknown.setdefault(int(seen[0].classes[len(seen[0].core) + zlib.crc32(w[-3:]) % 16]), w)
        assert sum(p(v, w) for w in count) + sum(p(v, w) for w in unknown.values()) <= 1 + 1e-9


def test_held_out_texts_are_not_learned(spark):
    docs = [(i, t) for i, t in corpus() if i is not None and i < 160]
    other = [(i, "entirely other words" if held(i) else t) for i, t in docs]
    scores = lambda rows: {(r.doc_id, r.score) for r in B.score(spark.createDataFrame(rows, "doc_id long, text string"), 6, 12, 8, 3).where("not held_out").collect()}
    assert {i for i, _ in docs if held(i)} and scores(docs) == scores(other)


def test_classes_beat_single_words(spark):
    docs = [r for r in corpus(600) if r[0] is not None and r[0] < 600]
    rows = B.score(spark.createDataFrame(docs, "doc_id long, text string"), 12, 24, 32).where("held_out").collect()
    assert len(rows) > 30
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.2 * sum(r.n_tokens for r in rows)


def test_best_class_is_that_of_a_recount():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, k = 9, 4
        pairs = rng.integers(0, 6, (n, n))
        classes = rng.integers(1, k, n)
        classes[0] = 0
        count = lambda c: np.array([[pairs[np.ix_(c == x, c == y)].sum() for y in range(k)] for x in range(k)], float)
        w = int(rng.integers(1, n))
        before = np.array([pairs[classes == c, w].sum() for c in range(k)])
        after = np.array([pairs[w, classes == c].sum() for c in range(k)])
        tried = []
        for c in range(1, k):
            moved = classes.copy()
            moved[w] = c
            tried.append(B.likelihood(count(moved)))
        to, gain = B.best_class(count(classes), before, after, int(classes[w]), pairs[w, w])
        assert tried[to - 1] == pytest.approx(max(tried)) and gain == pytest.approx(max(tried) - B.likelihood(count(classes)), abs=1e-6)
        m = count(classes)
        B.move(m, before.astype(float), after.astype(float), int(classes[w]), to, pairs[w, w])
        moved = classes.copy()
        moved[w] = to
        assert np.allclose(m, count(moved))


def test_exchange_gets_likelier(spark):
    found = B.blocks(spark.createDataFrame(corpus(), "doc_id long, text string"))
    vocabulary = found.selectExpr("explode(arrays_zip(words, seen)) as x").selectExpr("x.words as word", "x.seen as n").where("n > 0").groupBy("word").sum("n").toDF("word", "n")
    core = B.core_words(vocabulary, 20)
    assert len(core) <= 20 and core[b""] == 0
    classes, m, told = B.exchange(B.neighbours(found, core, 16), len(core), len(core) + 16, 8)
    assert max(told) > told[0] and (classes == 0).sum() == 1 and classes[0] == 0
    assert m.sum() == vocabulary.groupBy().sum("n").first()[0]


def test_empty_tables(spark):
    assert B.score(spark.createDataFrame([], SCHEMA)).collect() == []
    only = next(i for i in range(100) if held(i))
    row = B.score(spark.createDataFrame([(only, "a b", "", 0)], SCHEMA)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and math.isfinite(row.score) and row.base_score == pytest.approx(0.0)


def test_a_file_holds_one_block(spark, monkeypatch):
    from tablediff.llm import common

    written = []
    monkeypatch.setattr(common, "scratch_path", lambda spark, label, real=common.scratch_path: written.append(real(spark, label)) or written[-1])
    docs = spark.createDataFrame([(i, "red cat sleeps " * 20) for i in range(60)], "doc_id long, text string").coalesce(1)
    assert B.score(docs, 6, 12, 8, 1, 2000).count() == 60
    blocks = spark.read.parquet(next(p for p in written if "brown-blocks" in p)).groupBy("_metadata.file_path").count().collect()
    assert len(blocks) > 5 and {r["count"] for r in blocks} == {1}
