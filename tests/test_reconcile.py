"""Estimating, telling and comparing differences from sketches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablediff.operators import reconcile as R
from tablediff.operators.diff import TableDiff

ORDERS = "/root/testdata/sf0.01/orders.parquet"


def edited(spark, n):
    a = spark.read.parquet(ORDERS).select("o_orderkey", "o_custkey", "o_orderstatus")
    keys = [r[0] for r in a.select("o_orderkey").orderBy("o_orderkey").limit(n).collect()] if n else [-1]
    return a, a.withColumn("o_custkey", F.when(F.col("o_orderkey") <= max(keys), F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))


@pytest.mark.parametrize("edits", [0, 10, 1000, 15000])
def test_estimate_within_a_factor_of_two(spark, edits):
    a, b = edited(spark, edits)
    found = R.difference(a, b, a.columns)
    assert found.source_rows == found.target_rows == a.count()
    assert edits <= found.rows <= 4 * edits  # an edited row is a row less and a row more: twice the edits
    if edits <= 10:
        assert found.rows == 2 * edits and len(found.ids) == 2 * edits
    if found.ids is None:
        told = R.decode(a, b, a.columns, 2 * found.rows)
        assert len(told) == 2 * edits and sum(told.values()) == 0


def test_strategy_follows_the_estimate():
    d = lambda n, ids=None: R.choose(R.Difference(n, 0, 0, ids)).value
    assert d(3, {1: 1}) == d(R.DECODED) == "SKETCH_DIFF" and d(R.DECODED + 1) == "HASH_DIFF" and d(10**9) == "JOIN_DIFF"


def test_copies_are_told_with_their_number(spark):
    rows = [(1, "x")] * 5 + [(2, "y")] * 2 + [(3, None), (4, "")]
    a = spark.createDataFrame(rows, "k int, v string")
    b = spark.createDataFrame([(1, "x")] * 3 + [(5, "z")] * 2 + [(3, ""), (4, "")], "k int, v string")
    assert Counter(R.difference(a, b, ["k", "v"]).ids.values()) == Counter([2, 2, 1, -2, -1])
    assert R.difference(a, a, ["k", "v"]).ids == {} and R.difference(a.limit(0), b.limit(0), ["k", "v"]).ids == {}


def test_too_many_rows_for_the_cells_are_not_told(spark):
    a = spark.range(5000)
    assert R.decode(a, a.limit(0), ["id"], 1000) is None
    assert len(R.decode(a, a.limit(0), ["id"], 7000)) == 5000


def outcome(rows):
    return Counter((str(r.key), r.status, str(r.mismatched_columns), str(r.source_values), str(r.target_values)) for r in rows.where("status <> 'matched'").collect())


@pytest.mark.parametrize("null_keys", ["equal", "sql"])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_join(spark, null_keys, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "x", "y"]), rng.choice([0.0, -0.0, float("nan"), 1.5])) for _ in range(150)]
    target = [(k, "edited" if rng.random() < 0.1 else v, d) for k, v, d in rows if rng.random() > 0.05] + [(90, "new", None)] * 3
    a, b = (spark.createDataFrame(x, "k int, v string, d double") for x in (rows, target))
    diff = TableDiff(a, b, "k", null_keys=null_keys)
    want = diff.compare("JOIN_DIFF")
    for algorithm in ("SKETCH_DIFF", "AUTO"):
        run = diff.compare(algorithm, matched_rows=False)
        assert run.error is None and run.algorithm.value == "SKETCH_DIFF" and not run.warnings
        assert outcome(run.rows) == outcome(want.rows)
        assert run.summary == want.summary
    fan = TableDiff(a, b, "k", duplicates="fanout", null_keys=null_keys)
    auto = fan.compare("AUTO", matched_rows=False)
    assert auto.algorithm.value == "HASH_DIFF" and outcome(auto.rows) == outcome(fan.compare("JOIN_DIFF").rows)
    assert "duplicates" in fan.compare("SKETCH_DIFF").error


def test_many_differences_are_left_to_hashes_or_the_join(spark, monkeypatch):
    monkeypatch.setattr(R, "DECODED", 100)
    a, b = edited(spark, 1000)
    diff = TableDiff(a, b, "o_orderkey")
    auto, forced = diff.compare("AUTO", matched_rows=False), diff.compare("SKETCH_DIFF")
    assert auto.algorithm.value == forced.algorithm.value == "HASH_DIFF" and len(forced.warnings) == 1 and not auto.warnings
    assert auto.summary == forced.summary and auto.summary.modified == 1000
    monkeypatch.setattr(R, "BROADCAST_ROWS", 200)
    assert diff.compare("AUTO", matched_rows=False).algorithm.value == "JOIN_DIFF"
    assert diff.compare("AUTO").algorithm.value == "JOIN_DIFF"
