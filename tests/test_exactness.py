import itertools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablediff.operators.diff import TableDiff
from tablediff.sources.config import Config
from tablediff.sources.registry import open_source

WAYS = [("JOIN_DIFF", {}), ("CROSS_DB_DIFF", {}), ("HASH_DIFF", {}), ("BISECTION", {}), ("BISECTION", {"mode": "range"})]


def statuses(run):
    assert run.error is None
    return sorted(((tuple(r.key), r.status, sorted(r.mismatched_columns)) for r in run.differences.collect()), key=str), run.summary


@pytest.mark.parametrize("null_keys, duplicates", list(itertools.product(("equal", "sql"), ("multiset", "fanout"))))
def test_all_strategies_tell_the_same(spark, null_keys, duplicates):
    left = [(None, 1, "a"), (None, 2, "a"), (1, 1, "b"), (1, 1, "b"), (2, None, "c"), (2, None, "d")] + [(i, i, "x") for i in range(3, 60)]
    right = [(None, 1, "a"), (1, 1, "b"), (1, 1, "e"), (2, None, "c")] + [(i, i, "y" if i == 40 else "x") for i in range(4, 61)]
    a, b = (spark.createDataFrame(rows, "k int, l int, v string") for rows in (left, right))
    told = [statuses(TableDiff(a, b, ["k", "l"], null_keys=null_keys, duplicates=duplicates).compare(way, **options)) for way, options in WAYS]
    assert all(t == told[0] for t in told)
    if null_keys == "sql":
        assert told[0][1].deleted >= 4 and not [r for r in told[0][0] if None in r[0] and r[1] == "modified"]


def test_null_keys_of_one_row_each_as_sql(spark):
    a, b = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int"), spark.createDataFrame([(None, 1)], "k int, v int")
    for way, options in WAYS:
        s = TableDiff(a, b, "k", null_keys="sql").compare(way, **options).summary
        assert (s.deleted, s.added, s.matched) == (2, 1, 0)


@pytest.mark.parametrize("x, y, kinds, same", [
    (2**62, float(2**62), "long double", True), (2**62 + 1, float(2**62), "long double", False), (2**53 + 1, float(2**53), "long double", False), (-(2**62), -float(2**62), "long double", True), (5, 5.0, "int double", True), (0, -0.0, "long double", True),
    (Decimal(0), 1e-20, "decimal(38,18) double", False), (Decimal("1E-20"), 1e-20, "decimal(38,30) double", True), (Decimal("0.10"), 0.1, "decimal(5,2) double", True), (Decimal("0.1"), 0.1 + 2**-50, "decimal(38,18) double", False),
    (Decimal(2**64), float(2**64), "decimal(38,0) double", True), (Decimal(2**64 + 1), float(2**64), "decimal(38,0) double", False), (Decimal(-(2**100)), -float(2**100), "decimal(38,0) double", True), (Decimal(10**37), 1e37, "decimal(38,0) double", Decimal(10**37) == Decimal(1e37)),
    (1, 1e300, "long double", False), (1, float("nan"), "long double", False), (1, float("inf"), "long double", False), (None, 0.0, "long double", False), (3, Decimal("3.000"), "int decimal(9,3)", True), (3, Decimal("3.001"), "int decimal(9,3)", False),
])
def test_values_of_different_types_are_compared_exactly(spark, x, y, kinds, same):
    ka, kb = kinds.split()
    a, b = spark.createDataFrame([(1, x)], f"k int, v {ka}"), spark.createDataFrame([(1, y)], f"k int, v {kb}")
    for one, two in ((a, b), (b, a)):
        assert TableDiff(one, two, "k").compare("JOIN_DIFF").match == same


def test_maps_and_variants_at_any_depth(spark):
    make = lambda first, second, v: spark.range(1).select("id", F.expr(f"named_struct('n', 1, 'm', array(map('a', {first}, 'b', {second})))").alias("s"), F.parse_json(F.lit(v)).alias("j"), F.expr(f"map('x', map('p', {first}, 'q', 2))").alias("m"))
    turned = spark.range(1).select("id", F.expr("named_struct('n', 1, 'm', array(map('b', 2, 'a', 1)))").alias("s"), F.parse_json(F.lit('{"b":2, "a":1}')).alias("j"), F.expr("map('x', map('q', 2, 'p', 1))").alias("m"))
    for way, options in WAYS[:4]:
        assert TableDiff(make(1, 2, '{"a":1,"b":2}'), turned, "id").compare(way, **options).match
        wrong = TableDiff(make(3, 2, '{"a":1,"b":3}'), turned, "id").compare(way, **options).differences.collect()
        assert [sorted(r.mismatched_columns) for r in wrong] == [["j", "m", "s"]]


def csv(spark, tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return open_source(spark, Config("csv", path=str(tmp_path))).table()


def test_files_are_put_together_by_column_name(spark, tmp_path):
    df = csv(spark, tmp_path, a="id,name\n1,x\n2,y\n", b="name,id\nz,3\n", c="id;extra;name\n4;e;w\n")
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "extra": "string"}
    assert sorted((r.id, r.name, r.extra) for r in df.collect()) == [(1, "x", None), (2, "y", None), (3, "z", None), (4, "w", "e")]


def test_types_are_those_of_all_files(spark, tmp_path):
    df = csv(spark, tmp_path, a="id,n,d\n1,1,2024-01-02\n2,2.5,NA\n", b="id;n;d\nab;3;2024-01-03\n")
    assert dict(df.dtypes) == {"id": "string", "n": "double", "d": "date"}
    assert sorted(r.id for r in df.collect()) == ["1", "2", "ab"]


def test_large_whole_numbers_stay_apart(spark, tmp_path):
    one, two = "12345678901234567890", "12345678901234567891"
    df = csv(spark, tmp_path, a=f"id,long,mixed\n{one},{'9' * 40},1.5\n{two},1,{one}\n")
    assert dict(df.dtypes) == {"id": "decimal(38,0)", "long": "string", "mixed": "string"}
    assert df.select("id").distinct().count() == 2 and {str(r.id) for r in df.collect()} == {one, two}
