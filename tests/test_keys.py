"""Key discovery and samples by a hash of the key."""

import random
from itertools import combinations

import pytest

from tablediff.operators.keys import find_keys
from tablediff.operators.sample import bottom_k, key_share

COLUMNS = ["a", "b", "c", "d"]


def brute(rows, most):
    found = []
    for size in range(1, most + 1):
        for group in combinations(range(len(COLUMNS)), size):
            if not any(set(k) <= set(group) for k in found) and len({tuple(r[i] for i in group) for r in rows}) == len(rows):
                found.append(group)
    return [tuple(COLUMNS[i] for i in g) for g in found]


@pytest.mark.parametrize("seed", range(4))
def test_keys_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(30), rng.choice([None, "x", "y", ""]), rng.randrange(12), rng.choice([None, rng.randrange(400)])) for _ in range(120)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "a int, b string, c int, d int")
    assert find_keys(df, 4) == brute(rows, 4)


def test_keys_of_odd_tables(spark):
    one = "`a b` int, `c.d` map<string,int>"
    assert find_keys(spark.createDataFrame([], one)) == [("a b",), ("c.d",)]
    assert find_keys(spark.createDataFrame([(1, {"x": 1}), (1, {"x": 2})], one)) == [("c.d",)]
    assert find_keys(spark.createDataFrame([(1, {"x": 1, "y": 2}), (1, {"y": 2, "x": 1})], one)) == []
    assert find_keys(spark.createDataFrame([(float("nan"),), (float("nan"),)], "a double")) == []
    assert find_keys(spark.createDataFrame([(None,), (1,)], "a int"), columns=["A"]) == [("a",)]
    with pytest.raises(ValueError):
        find_keys(spark.range(1), 0)


def test_samples_by_key_are_the_same_on_every_run(spark):
    df = spark.range(3000).selectExpr("id as k", "id % 7 as v")
    first = bottom_k(df, ["k"], 500)
    again = bottom_k(df.repartition(13, "v"), ["K"], 500)
    assert {r.k for r in first.collect()} == {r.k for r in again.collect()} and first.count() == 500
    # what is the sample of the parts together is the sample of the whole
    parts = [bottom_k(df.where(f"v % 2 = {i}"), ["k"], 500) for i in (0, 1)]
    assert {r.k for r in bottom_k(parts[0].union(parts[1]), ["k"], 500).collect()} == {r.k for r in first.collect()}
    shared = {r.k for r in key_share(df, ["k"], 0.2).collect()}
    assert 450 < len(shared) < 750 and shared == {r.k for r in key_share(df.orderBy("v"), ["k"], 0.2).collect()}
    assert key_share(df, ["k"], 1).count() == 3000 and key_share(df, ["k"], 0).count() == 0


def test_samples_of_odd_tables(spark):
    hot = spark.createDataFrame([(1, i) for i in range(400)] + [(None, 0)] * 5, "k int, v int")
    for n in (0, 1, 37, 404, 405, 900):
        rows = bottom_k(hot, ["k"], n).collect()
        assert len(rows) == min(n, 405) and rows == bottom_k(hot.repartition(7), ["k"], n).collect()
    assert bottom_k(hot.limit(0), ["k"], 5).count() == 0
    assert key_share(hot, ["k"], 0.5).count() in (0, 5, 400, 405)
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            key_share(hot, ["k"], bad)
    with pytest.raises(ValueError):
        bottom_k(hot, ["k"], -1)
