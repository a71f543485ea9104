import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tablediff.llm import resample as R

SCHEMA = "doc_id long, text string, score string, row int"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def found_in(text, n, buckets):
    own = words(text)
    return [zlib.crc32(" ".join(own[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(own) - k + 1)]


def brute(docs, target, n, buckets, least, share, seed):
    source = Counter(b for _, t in docs for b in found_in(t, n, buckets))
    wanted = Counter(b for t in target for b in found_in(t, n, buckets))
    s, t = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in source}
    rows = []
    for doc_id, text in docs:
        own = found_in(text, n, buckets)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    drawn = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for i, r in enumerate(drawn[: len(drawn) * share // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_equals_brute_force_whatever_the_chunks(spark, n):
    long = " ".join(f"Wort{i % 37} é{i % 11}x, B{i % 5}" for i in range(900))
    docs = [(i, f"Alpha beta{i % 7} {'gamma ' * (i % 30)} δέλτα-{i}") for i in range(60)]
    docs += [(100, long), (101, long), (101, long), (102, "x" * 5000), (103, "one  two\n\n" * 400 + "x"), (104, None), (105, ""), (106, " \t\n.,-"), (None, "null id " * 30), (107, "ab cd"), (3, "again and again " * 12)]
    target = ["gamma beta1 beta2", "wort1 ÉX b1", None, "", long[:3000]]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], SCHEMA).repartition(3)
    want = brute(docs, target, n, 500, 5, 40, 7)
    for long_bytes, chunk_bytes in ((1 << 16, 1 << 15), (300, 100), (50, 7)):
        got = R.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n, 500, 5, 40, 7, long_bytes, chunk_bytes)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_chunks_own_each_word_once():
    clean = b"aa bb  cc dd ee ff " * 50 + b"zz"
    for size in (1, 3, 10, 1000):
        for n in (1, 2, 4):
            parts = list(R.chunks(clean, n, size))
            assert [w for own, _ in parts for w in own.split()] == clean.split()
            rest = clean.split()
            for own, carried in parts:
                rest = rest[len(own.split()) :]
                assert carried.split() == rest[: n - 1]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b c " * 20, "", 0), (2, "a b c d " * 20, "", 0)], SCHEMA)
    assert R.resample(none, some).collect() == []
    rows = R.resample(some, none.select("text"), share=50).collect()
    assert sorted(r["rank"] or 0 for r in rows) == [0, 1]


def test_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(R.OP11_SQL)
    columns = [d[0] for d in want.description]
    got = R.op11_resample(spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
