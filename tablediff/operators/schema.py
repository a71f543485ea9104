"""Schema comparison, common columns and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import column, common_columns, resolve
from ..functions.types import from_spark


def schema_rows(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, from_spark(f.dataType), f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, data_type string, native_type string, nullable boolean")


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row for each difference between two tables of columns (name, data_type, nullable): only_in_a, only_in_b or different."""
    joined = a.alias("a").join(b.alias("b"), F.lower("a.name") == F.lower("b.name"), "full_outer")
    kind = F.when(F.col("b.name").isNull(), "only_in_a").when(F.col("a.name").isNull(), "only_in_b").when(~F.col("a.data_type").eqNullSafe(F.col("b.data_type")) | ~F.col("a.nullable").eqNullSafe(F.col("b.nullable")), "different")
    return joined.select(F.coalesce("a.name", "b.name").alias("name"), kind.alias("kind"), F.col("a.data_type").alias("type_a"), F.col("b.data_type").alias("type_b"), F.col("a.nullable").alias("nullable_a"), F.col("b.nullable").alias("nullable_b")).where("kind is not null")


def compare_schemas(a: DataFrame, b: DataFrame, row_counts: tuple[int, int] | None = None, sizes: tuple[int, int] | None = None) -> dict:
    """Differences as a dictionary; counts and sizes are a's less b's where they are given."""
    pairs = common_columns(a.columns, b.columns)
    in_a, in_b = {x for x, _ in pairs}, {y for _, y in pairs}
    fields = lambda df: {f.name: f for f in df.schema}
    fa, fb = fields(a), fields(b)
    different = [{"column": x, "type_a": from_spark(fa[x].dataType), "type_b": from_spark(fb[y].dataType), "nullable_a": fa[x].nullable, "nullable_b": fb[y].nullable} for x, y in pairs if from_spark(fa[x].dataType) != from_spark(fb[y].dataType) or fa[x].nullable != fb[y].nullable]
    out = {"columns_only_in_a": [c for c in a.columns if c not in in_a], "columns_only_in_b": [c for c in b.columns if c not in in_b], "different": different}
    if row_counts:
        out["row_count_difference"] = row_counts[0] - row_counts[1]
    if sizes:
        out["size_difference"] = sizes[0] - sizes[1]
    return out


def check_schema(a: DataFrame, b: DataFrame, strict: bool = False) -> bool:
    """Whether both have the same columns; with strict, of the same types and nullability too."""
    found = compare_schemas(a, b)
    return not found["columns_only_in_a"] and not found["columns_only_in_b"] and not (strict and found["different"])


def project_common(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the common columns only, under a's names and in a's order."""
    pairs = common_columns(a.columns, b.columns)
    if not pairs:
        raise ValueError("No common columns found between tables")
    return a.select(*[column(x) for x, _ in pairs]), b.select(*[column(y).alias(x) for x, y in pairs])


def primary_keys(df: DataFrame) -> list[str]:
    """Columns whose metadata marks them as primary key."""
    return [f.name for f in df.schema if f.metadata.get("primary_key")]


def mark_primary_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    taken = {resolve(k, df.columns) for k in keys}
    return df.select(*[column(f.name).alias(f.name, metadata={**f.metadata, "primary_key": True}) if f.name in taken else column(f.name) for f in df.schema])


def key_uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, distinct_keys, is_unique. Keys are grouped first, so no task holds all of one key."""
    named = [resolve(k, df.columns) for k in keys]
    grouped = df.groupBy(*[column(k) for k in named]).agg(F.count("*").alias("n"))
    return grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys")).withColumn("is_unique", F.col("rows") == F.col("distinct_keys"))
