"""Samples: a head for few rows, a random fraction and a limit for many; samples by a hash of the key, which come out the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import row_hash, row_text, short_hash
from ..functions.names import resolve

# Where sampling starts, and the largest sample of each system.
HEAD_UP_TO = 1000
MAX_SAMPLE_ROWS = {"postgresql": 100_000, "snowflake": 100_000, "mysql": 100_000, "bigquery": 1_000_000, "databricks": 1_000_000}
MYSQL_CAP = 10_000


def percentage(n: int, system: str = "postgresql") -> float:
    return min(10.0, max(0.1, n / MAX_SAMPLE_ROWS[system] * 100))


def sample(df: DataFrame, n: int = 100, system: str | None = None, seed: int | None = None) -> DataFrame:
    """n rows. Without a system, or up to HEAD_UP_TO rows, the first that come; else a random fraction, or for mysql a random order."""
    if n < 0:
        raise ValueError("n must not be negative")
    if system == "mysql":
        return df.orderBy(F.rand(seed)).limit(min(n, MYSQL_CAP))
    if system is None or n <= HEAD_UP_TO:
        return df.limit(n)
    n = min(n, MAX_SAMPLE_ROWS[system])
    return df.sample(percentage(n, system) / 100, seed=seed).limit(n)


def sampling_sql(table: str, n: int, system: str) -> str:
    """The same as SQL text for a remote system."""
    if system == "mysql":
        return f"SELECT * FROM {table} ORDER BY RAND() LIMIT {min(n, MYSQL_CAP)}"
    if n <= HEAD_UP_TO:
        return f"SELECT * FROM {table} LIMIT {n}"
    p = percentage(n, system)
    how = {"postgresql": f"TABLESAMPLE BERNOULLI ({p:g})", "snowflake": f"TABLESAMPLE ({p:g})", "bigquery": f"TABLESAMPLE SYSTEM ({p:g} PERCENT)", "databricks": f"TABLESAMPLE ({p:g} PERCENT)"}[system]
    return f"SELECT * FROM {table} {how} LIMIT {n}"


def key_share(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """All rows of about this share of the keys: the same keys in every table and on every run, whatever its order or partitions.

    A filter, without a shuffle; rows of one key come together or not at all, so samples of two tables can be compared. Null keys
    are keys like others. share 0 gives none and 1 gives all.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must be from 0 to 1")
    return df.where(short_hash(row_text([resolve(k, df.columns) for k in keys], df.schema)) < int(share * 16**15))


def bottom_k(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Exactly n rows, or all if there are fewer: those with the smallest MD5 of the key, the same on every run; samples of parts can be merged.

    Rows are counted first, then only those under a bound that n rows stay under are put in order, so about n rows move, not n from
    each partition. If too few are (keys that repeat), the bound grows by four until it holds all. Rows of one key go by the hash
    of the whole row; equal rows are interchangeable.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    keys = [resolve(k, df.columns) for k in keys]
    rows = df.count()
    share = min(1.0, (n + 6 * n**0.5 + 20) / max(rows, 1))
    few = key_share(df, keys, share)
    while share < 1 and few.count() < n:
        share = min(1.0, share * 4)
        few = key_share(df, keys, share)
    return few.orderBy(row_hash(keys, df.schema, 128), row_hash(df.columns, df.schema, 128)).limit(n)
