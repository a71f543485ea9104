import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablediff.functions.canonical import DERBY_FUNCTIONS, DIALECTS, canonical, digest_number, literal, row_digest
from tablediff.functions.types import COMMON_TYPES
from tablediff.operators import remote
from tablediff.operators.diff import TableDiff
from tablediff.plans.queries import derby

TYPES = "id int, i long, d decimal(12,4), b boolean, day date, moment timestamp, s string"


def rows(n=400):
    t = dt.datetime(2024, 2, 29, 23, 59, 59, 120000)
    return [(i, None if i % 11 == 0 else i * 10**9 - 5, None if i % 7 == 0 else Decimal(i * 37 - 500) / 8, None if i % 5 == 0 else i % 2 == 0, dt.date(1999, 12, 31) + dt.timedelta(i), t + dt.timedelta(seconds=i, microseconds=(i % 3) * 1001), None if i % 13 == 0 else "" if i % 13 == 1 else f"é{i}'V1:x") for i in range(n)]


def edited(found):
    out = [r for r in found if r[0] % 97 != 3]
    out = [(*r[:6], "changed") if r[0] in (50, 51, 320) else r for r in out]
    out = [(*r[:2], r[2] and r[2] + Decimal("0.0001"), *r[3:]) if r[0] == 100 else r for r in out]
    return out + [(r[0] + 100_000, *r[1:]) for r in found[:2]]


def outcome(run):
    assert run.error is None
    same = lambda v: tuple(v.asDict().values()) if v else None
    return sorted(((tuple(r.key), r.status, sorted(r.mismatched_columns), same(r.source_values) if r.status != "matched" else None, same(r.target_values) if r.status != "matched" else None) for r in run.differences.collect()), key=str), run.summary


@pytest.fixture(scope="module")
def sides(spark):
    a, b = spark.createDataFrame(rows(), TYPES), spark.createDataFrame(edited(rows()), TYPES)
    return a, b, derby(spark, a), derby(spark, b)


@pytest.mark.parametrize("algorithm, duplicates", [("HASH_DIFF", "multiset"), ("BISECTION", "fanout")])
def test_equals_the_comparison_of_whole_tables(sides, algorithm, duplicates):
    a, b, in_a, in_b = sides
    want = outcome(TableDiff(a, b, "id", duplicates=duplicates).compare("JOIN_DIFF"))
    for x, y in (((in_a, "T"), (in_b, "T")), ((in_a, "T"), b), (a, (in_b, "T")), (a, b)):
        run = remote.RemoteDiff(x, y, "id", duplicates=duplicates).compare(algorithm)
        assert outcome(run) == want


def test_only_rows_that_differ_are_read(spark, monkeypatch):
    a = spark.range(30_000).select("id", (F.col("id") % 97).cast("decimal(9,2)").alias("v"))
    b = a.withColumn("v", F.when(F.col("id") % 2000 == 77, -1).otherwise(F.col("v")).cast("decimal(9,2)"))
    in_a, in_b = derby(spark, a), derby(spark, b)
    run = remote.RemoteDiff((in_a, "T"), (in_b, "T"), "id").compare("BISECTION")
    assert run.summary.modified == 15 and run.summary.matched == 30_000 - 15
    assert run.metadata["rows_read"] + run.metadata["sums_read"] < 4000 and run.metadata["segments_differing"] == 15
    asked = []
    real = type(in_a).rows_where
    monkeypatch.setattr(type(in_a), "rows_where", lambda self, name, where: asked.append(where) or real(self, name, where))
    run = remote.RemoteDiff((in_a, "T"), (in_b, "T"), "id").compare("HASH_DIFF")
    assert run.rows.count() == 15 and run.metadata["rows_in_equal_segments"] == 30_000 - 15
    assert [w.count(",") for w in asked[0]] == [14]
    over = remote.RemoteDiff((in_a, "T"), (in_b, "T"), "id").compare("HASH_DIFF", fetch_keys=3)
    assert over.metadata["read"] == "tables" and over.summary == run.summary


@pytest.mark.parametrize("null_keys", ["equal", "sql"])
def test_null_repeated_and_composite_keys(spark, null_keys):
    kind = "k int, t string, v decimal(5,1)"
    left = [(1, "a", Decimal(1)), (1, "a", Decimal(1)), (1, "b", Decimal(2)), (None, "a", Decimal(3)), (None, "a", Decimal(4)), (2, None, Decimal(5)), (3, "x'y", Decimal(6))]
    right = [(1, "a", Decimal(1)), (1, "b", Decimal(2)), (None, "a", Decimal(3)), (2, None, Decimal(7)), (3, "x'y", Decimal(8)), (4, "z", None)]
    a, b = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)
    in_a, in_b = derby(spark, a), derby(spark, b)
    want = outcome(TableDiff(a, b, ["k", "t"], null_keys=null_keys).compare("JOIN_DIFF"))
    got = outcome(remote.RemoteDiff((in_a, "T"), (in_b, "T"), ["k", "t"], null_keys=null_keys).compare("HASH_DIFF"))
    assert got == want


def test_floating_values_are_sent_and_compared_as_they_are(spark):
    a = spark.createDataFrame([(1, 0.1, 1.5), (2, 1e300, 2.5), (3, None, 3.5)], "k int, x double, y float")
    b = spark.createDataFrame([(1, 0.1 + 2**-56, 1.5), (2, 1e300, 2.5), (3, None, 3.75)], "k int, x double, y float")
    run = remote.RemoteDiff((derby(spark, a), "T"), b, "k").compare()
    assert {r.key.k: r.mismatched_columns for r in run.differences.collect()} == {1: ["x"], 3: ["y"]}
    assert "cannot be summed" in remote.RemoteDiff(a, b, "k").compare("BISECTION").error


def test_canonical_text_is_the_same_in_derby_and_spark(spark, sides):
    a, _, in_a, _ = sides
    kinds = {"i": "int64", "d": "decimal", "b": "boolean", "day": "date", "moment": "timestamp", "s": "string"}
    texts = lambda system, quote: {c: canonical(system, k, f"{quote}{c}{quote}", 4) for c, k in kinds.items()}
    ask = lambda system, quote: f"select {quote}id{quote} as id, " + ", ".join(f"{t} as {c}" for c, t in texts(system, quote).items()) + f", {digest_number(system, row_digest(system, list(texts(system, quote).values())))} as h from "
    here = spark.sql(ask("databricks", "`") + "{t}", t=a).collect()
    there = in_a.remote_query(ask("derby", '"') + "T").collect()
    assert sorted(map(tuple, here)) == sorted(map(tuple, there))
    assert {r[5] for r in here if r[0] == 1} == {"2024-03-01 00:00:00.121001"}


def test_every_type_has_a_text_or_is_read():
    plain = {"string", "text", "uuid", "decimal", "boolean", "date", "datetime", "timestamp", *(t for t in COMMON_TYPES if "int" in t)}
    for system in DIALECTS:
        for kind in COMMON_TYPES:
            text = canonical(system, kind, "x", 2)
            assert (text is not None) == (kind in plain or kind == "binary" and system != "derby"), (system, kind)
    # numbers are made texts before they are joined, which some systems ask for
    assert row_digest("bigquery", ["a"]) == "to_hex(md5(coalesce(concat('V', cast(char_length(a) as string), ':', a), 'N')))"
    assert literal("derby", dt.date(2024, 1, 2)) == "date('2024-01-02')" and literal("mysql", "a'b") == "'a''b'" and literal("derby", Decimal("1.50")) == "1.50"
    with pytest.raises(ValueError):
        canonical("oracle", "string", "x")
    assert len(DERBY_FUNCTIONS) == 2


def test_queries_run_on_a_cluster():
    """Executors in JVMs of their own, as on a cluster; rows as many as those of the SQL, the rows themselves are compared elsewhere."""
    import os
    import subprocess
    import sys

    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("create view orders as select * from '/root/testdata/sf0.001/orders.parquet'")
    want = [len(con.execute(entry.oracle_sql()[q]).fetchall()) for q in ("remote_hash_diff", "remote_segment_diff", "remote_row_hashes")]

    run = """
from pyspark.sql import SparkSession
import __spark_entry__ as entry, tempfile
folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
b = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + folder).config("spark.local.dir", folder).config("spark.sql.shuffle.partitions", "4")
spark = b.getOrCreate()
print([entry.queries()[q](spark, "/root/testdata/sf0.001").count() for q in ("remote_hash_diff", "remote_segment_diff", "remote_row_hashes")])
spark.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = subprocess.run([sys.executable, "-c", run], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert found.stdout.strip().endswith(str(want)), found.stderr[-2000:]
