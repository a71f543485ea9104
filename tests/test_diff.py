import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablediff import TableDiff
from tablediff.operators.bisect import with_segments

ALGORITHMS = ("JOIN_DIFF", "CROSS_DB_DIFF", "HASH_DIFF", "BISECTION")


def outcome(run):
    return sorted((tuple(r.key), r.status, tuple(r.mismatched_columns)) for r in run.differences.collect())


def compare(spark, a, b, schema, algorithm="JOIN_DIFF", keys="k", **options):
    return TableDiff(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), keys, **options).compare(algorithm)


KV, KVW = "k int, v string", "k int, v string, w string"


@pytest.mark.parametrize("algorithm", ALGORITHMS)
@pytest.mark.parametrize(("a", "b", "schema", "expected"), [
    ([(1, None)], [(1, "x")], KV, [((1,), "modified", ("v",))]),
    ([(1, None)], [(1, None)], KV, []),
    ([(1, None)], [(1, "")], KV, [((1,), "modified", ("v",))]),
    ([(1, "ab", "c")], [(1, "a", "bc")], KVW, [((1,), "modified", ("v", "w"))]),
    ([(1, "a|b", "c")], [(1, "a", "b|c")], KVW, [((1,), "modified", ("v", "w"))]),
    ([(1, math.nan)], [(1, math.nan)], "k int, v double", []),
    ([(1, 0.0)], [(1, -0.0)], "k int, v double", []),
    ([(None, "x")], [(None, "x")], KV, []),
    ([(1, "x"), (1, "x")], [(1, "x")], KV, [((1,), "deleted", ())]),
    ([(1, "x")], [(1, "x"), (2, "y")], KV, [((2,), "added", ())]),
    ([(1, "A"), (1, "B")], [(1, "A")], KV, [((1,), "deleted", ())]),
    ([(1, "B"), (1, "C"), (1, None)], [(1, None), (1, "A"), (1, "C")], KV, [((1,), "modified", ("v",))]),
    ([(None, "x"), (None, "y")], [(None, "y"), (None, "y")], KV, [((None,), "modified", ("v",))]),
])
def test_edge_rows(spark, algorithm, a, b, schema, expected):
    assert outcome(compare(spark, a, b, schema, algorithm)) == expected


def test_null_keys_as_in_sql(spark):
    run = compare(spark, [(None, "x")], [(None, "x")], KV, null_keys="sql")
    assert sorted(s for _, s, _ in outcome(run)) == ["added", "deleted"]


def test_duplicates_can_be_refused(spark):
    assert "duplicate" in compare(spark, [(1, "x"), (1, "x")], [(1, "x")], KV, duplicates="error").error


def test_names_and_types(spark):
    a = spark.createDataFrame([(1, "x", 5)], "id int, V string, only_a int")
    b = spark.createDataFrame([(1, "x")], "ID long, v string")
    run = TableDiff(a, b, "id").compare()
    assert run.match and not run.schema_match
    assert run.schema_differences["columns_only_in_a"] == ["only_a"]
    assert run.common_columns == ["id", "V"]
    renamed = TableDiff(a, b.withColumnRenamed("ID", "other"), ["id"], ["other"]).compare()
    assert renamed.match and renamed.keys == ["id"]


def test_errors(spark):
    a, z = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "z int")
    assert TableDiff(a, a, ["a", "a"], ["a"]).compare().error == "Key column lists must have equal length"
    assert TableDiff(a, z, ["a"], ["z"]).compare().error == "No common columns found between tables"
    with pytest.raises(ValueError):
        TableDiff(a, a, [])


def test_maps_and_empty_sides(spark):
    a = spark.createDataFrame([(1, {"x": 1, "y": 2})], "k int, m map<string,int>")
    b = spark.createDataFrame([(1, {"y": 2, "x": 1})], "k int, m map<string,int>")
    assert TableDiff(a, b, "k").compare().match
    run = TableDiff(a.limit(0), b, "k").compare("HASH_DIFF")
    assert (run.summary.added, run.summary.source_rows, run.summary.target_rows) == (1, 0, 1)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 60), st.sampled_from(["a", "b", None, ""]), max_size=40), st.dictionaries(st.integers(0, 60), st.sampled_from(["a", "b", None, "", "gone"]), max_size=15))
def test_edits_are_found_by_every_strategy(spark, rows, edits):
    target = {k: v for k, v in {**rows, **edits}.items() if v != "gone"}
    expected = sorted([((k,), "deleted", ()) for k in rows.keys() - target.keys()] + [((k,), "added", ()) for k in target.keys() - rows.keys()] + [((k,), "modified", ("v",)) for k in rows.keys() & target.keys() if rows[k] != target[k]])
    a, b = (spark.createDataFrame(list(d.items()), KV) for d in (rows, target))
    for algorithm, options in [*((x, {}) for x in ALGORITHMS), ("BISECTION", {"mode": "range", "threshold": 3})]:
        run = TableDiff(a, b, "k", duplicates="fanout").compare(algorithm, **options)
        assert outcome(run) == expected, (algorithm, options)
        assert run.summary.matched == len(rows.keys() & target.keys()) - sum(s == "modified" for _, s, _ in expected)


def brute_multiset(a, b):
    """status counts by key: equal rows first, then one to one."""
    from collections import Counter

    out = Counter()
    for k in {x for x, _ in a} | {x for x, _ in b}:
        x, y = Counter(v for i, v in a if i == k), Counter(v for i, v in b if i == k)
        equal, left, right = (x & y).total(), (x - y).total(), (y - x).total()
        out.update({(k, "matched"): equal, (k, "modified"): min(left, right), (k, "deleted"): max(left - right, 0), (k, "added"): max(right - left, 0)})
    return +out


ROWS = st.lists(st.tuples(st.sampled_from([None, 1, 2, 3, 40, 41, 99]), st.sampled_from(["a", "b", "", None])), max_size=30)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS, ROWS)
def test_multisets_by_every_strategy(spark, rows, target):
    from collections import Counter

    a, b = (spark.createDataFrame(x, KV) for x in (rows, target))
    for algorithm, options in [*((x, {}) for x in ALGORITHMS), ("BISECTION", {"mode": "range", "threshold": 3})]:
        run = TableDiff(a, b, "k").compare(algorithm, **options)
        found = Counter((r.key.k, r.status) for r in run.rows.collect())
        want = brute_multiset(rows, target)
        if algorithm == "BISECTION":  # rows of equal segments are counted only
            found, want = (Counter({k: n for k, n in x.items() if k[1] != "matched"}) for x in (found, want))
        assert found == want, (algorithm, options)
        s = run.summary
        assert (s.source_rows, s.target_rows, s.matched) == (len(rows), len(target), sum(n for (_, k), n in brute_multiset(rows, target).items() if k == "matched")), (algorithm, options)


@pytest.mark.parametrize(("a", "b", "kind_a", "kind_b", "equal"), [
    (2**53 + 1, float(2**53), "long", "double", False), (2**53, float(2**53), "long", "double", True), (-7, -7.0, "int", "double", True), (7, 7.5, "int", "double", False), (0, -0.0, "int", "double", True),
    ("1.50", 1.5, "decimal(5,2)", "double", True), ("0.10", 0.1, "decimal(5,2)", "double", True), ("9007199254740993", 9007199254740992.0, "decimal(20,0)", "double", False),
    ("12345678901234567890123456", "12345678901234567890123456.000", "decimal(30,0)", "decimal(38,3)", True), ("12345678901234567890123456", "12345678901234567890123457.000", "decimal(30,0)", "decimal(38,3)", False),
    ("5.000000000000000000", 5, "decimal(38,18)", "long", True), ("0.00", 0, "decimal(38,30)", "long", True), ("1.25", "1.250", "decimal(3,2)", "decimal(4,3)", True), (10, "10", "long", "decimal(38,0)", True),
    (1e300, 10, "double", "long", False), (math.nan, 1, "double", "long", False), (3, 3, "tinyint", "bigint", True),
])
def test_values_of_different_types(spark, a, b, kind_a, kind_b, equal):
    from decimal import Decimal

    make = lambda v, kind: spark.createDataFrame([(1, Decimal(v) if isinstance(v, str) else v)], f"k int, v {kind}")
    for x, y in ((make(a, kind_a), make(b, kind_b)), (make(b, kind_b), make(a, kind_a))):
        for algorithm in ("JOIN_DIFF", "HASH_DIFF"):
            assert TableDiff(x, y, "k").compare(algorithm).match == equal, (algorithm, x.schema, y.schema)


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "timestamp_ntz", "double", "decimal(12,2)", "binary", "boolean"])
def test_ranges_of_any_key(spark, kind):
    from pyspark.sql import functions as F

    number = F.col("id").cast("int")
    key = {"string": F.concat(F.lit("order-"), F.lpad(number.cast("string"), 5, "0")), "date": F.date_add(F.lit("2020-01-01"), number), "double": number / 7, "binary": F.col("id").cast("string").cast("binary"), "boolean": F.col("id") % 2 == 0}.get(kind, F.timestamp_seconds("id").cast(kind) if kind.startswith("time") else number.cast(kind))
    a = spark.range(3000).select(key.alias("k"), "id", F.lit("x").alias("v"))
    b = a.where("id <> 17").withColumn("v", F.when(F.col("id") == 2500, "y").otherwise(F.col("v")))
    run = TableDiff(a, b, ["k", "id"]).compare("BISECTION", mode="range", threshold=50)
    assert sorted((r.key.id, r.status) for r in run.differences.collect()) == [(17, "deleted"), (2500, "modified")]
    s = run.summary
    assert (s.source_rows, s.target_rows, s.matched) == (3000, 2999, 2998)
    if kind not in ("boolean",):
        assert run.metadata["depth_reached"] > 1 and run.rows.count() < 400


def test_segments_take_few_jobs_and_keep_nothing(spark):
    from pyspark.sql import functions as F

    a = spark.range(40_000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    b = a.withColumn("v", F.when(F.col("k") % 1000 == 0, 1).otherwise(0))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("ranges"))
    spark.sparkContext.setJobGroup("ranges", "ranges")
    try:
        run = TableDiff(a, b, "k").compare("BISECTION", mode="range", threshold=100)
        assert jobs() <= 6 * (run.metadata["depth_reached"] + 1) and run.metadata["segments_differing"] >= 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert run.differences.count() == 40
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_each_side_is_summed_once_however_deep(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tablediff.operators import bisect

    calls, real = [], bisect._sums
    monkeypatch.setattr(bisect, "_sums", lambda h: calls.append(1) or real(h))
    a = spark.range(20_000).select(F.when(F.col("id") > 20, F.col("id") % 9000).alias("k"), "id", F.lit(0).alias("v"))
    b = a.withColumn("v", F.when(F.col("id") % 7000 == 5, 1).otherwise(0))
    run = TableDiff(a, b, ["k", "id"]).compare("BISECTION", mode="range", threshold=100)
    assert run.metadata["depth_reached"] > 1 and len(calls) == 2
    assert sorted(r.key.id for r in run.differences.collect()) == [5, 7005, 14005] and run.summary.matched == 19_997


def test_warnings(spark):
    a = spark.createDataFrame([(1, "x", 5)], "id int, v string, s int")
    run = TableDiff(a, a, "id", segment_key="s").compare()
    assert run.match and "segment key" in run.warnings[0]
    run.detail(200_000)
    assert len(run.warnings) == 2 and not TableDiff(a, a, "id", segment_key="id").compare().warnings


def test_rows_that_change_segment_are_not_reported(spark):
    a, b = spark.range(1, 33).withColumnRenamed("id", "k"), spark.range(2, 33).withColumnRenamed("id", "k")
    assert outcome(TableDiff(a, b, "k", duplicates="fanout").compare("BISECTION")) == [((1,), "deleted", ())]


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17, 100])
def test_segments_equal_ntile(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k").repartition(3)
    got = {r.k: r.segment for r in with_segments(df, ["k"], 16).collect()}
    df.createOrReplaceTempView("ntile_rows")
    assert got == {r.k: r.s for r in spark.sql("select k, ntile(16) over (order by k) s from ntile_rows").collect()}


def test_orders_counts(spark):
    from tablediff.plans.queries import sides

    s = TableDiff(*sides(spark, "/root/testdata/sf0.001"), "o_orderkey").compare("HASH_DIFF").summary
    assert (s.source_rows, s.target_rows, s.added, s.deleted, s.modified, s.matched) == (1500, 1501, 17, 16, 53, 1431)
