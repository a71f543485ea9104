"""Records of connection attempts and queries, and their statistics.

A recorder keeps the last max_records of each kind on the driver; the statistics are grouped aggregations over a
frame, whether it comes from a recorder or from a stored table of any size.
"""

from __future__ import annotations

import csv
import io
import json
import threading
from collections import deque
from datetime import datetime, timedelta, timezone
from functools import reduce
from hashlib import md5
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ATTEMPT_SCHEMA = "connection_id string, source_type string, method string, duration double, success boolean, error string, ts timestamp"
QUERY_SCHEMA = "connection_id string, source_type string, query_hash string, duration double, rows_affected long, bytes long, success boolean, error string, at timestamp"
MAX_RECORDS, ERROR_LENGTH, ERROR_TYPE_LENGTH, RETENTION_HOURS = 10_000, 100, 50, 24


def error_type(error: Column) -> Column:
    return F.substring(F.trim(F.substring_index(error, ":", 1)), 1, ERROR_TYPE_LENGTH)


def _statistics() -> list[Column]:
    d, n = F.col("duration"), F.count("*")
    good = F.count(F.when(F.col("success"), 1))
    return [n.alias("total_attempts"), good.alias("successful_attempts"), (n - good).alias("failed_attempts"), (good / n).alias("success_rate"), F.avg(d).alias("avg_duration"), F.min(d).alias("min_duration"), F.max(d).alias("max_duration")]


def _with_places(found: DataFrame, own: DataFrame, by: list[str]) -> DataFrame:
    """found with median_duration and p95_duration, the value at place floor(0.95 * (n - 1)) counted from 0. Equal durations of a group are counted before the shuffle, and a running sum finds the places."""
    counts = own.where("duration is not null").groupBy(*by, "duration").agg(F.count("*").alias("__c"))
    group = Window.partitionBy(*by)
    counts = counts.withColumn("__to", F.sum("__c").over(group.orderBy("duration").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__c").over(group))
    at = lambda place: F.max(F.when((place >= F.col("__to") - F.col("__c")) & (place < F.col("__to")), F.col("duration")))
    last = F.col("__n") - 1
    places = counts.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("median_duration"), at(F.floor(F.lit(0.95) * last)).alias("p95_duration"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return found.join(places, same, "left").drop(*[f"__{c}" for c in by])


def filtered(df: DataFrame, source_type: str | None = None, method: str | None = None, connection_id: str | None = None, since: datetime | None = None) -> DataFrame:
    for name, value in (("source_type", source_type), ("method", method), ("connection_id", connection_id)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df if since is None else df.where(F.col("ts" if "ts" in df.columns else "at") >= F.lit(since))


def connection_statistics(attempts: DataFrame, **filters) -> DataFrame:
    own, by = filtered(attempts, **filters), ["source_type", "method"]
    return _with_places(own.groupBy(*by).agg(*_statistics()), own, by)


def method_comparison(attempts: DataFrame, **filters) -> DataFrame:
    own = filtered(attempts, **filters)
    total = own.agg(F.count("*").alias("__all"))
    found = own.groupBy("method").agg(*_statistics(), F.max("ts").alias("last_used"), F.sort_array(F.collect_set(error_type(F.col("error")))).alias("error_types"))
    found = _with_places(found, own, ["method"])
    return found.join(F.broadcast(total)).withColumn("usage", F.col("total_attempts") / F.col("__all")).drop("__all")  # total is one row


def query_statistics(queries: DataFrame, **filters) -> DataFrame:
    own = filtered(queries, **filters)
    good, n = F.col("success"), F.count("*")
    taken = F.when(good, F.col("duration"))
    minutes = (F.unix_timestamp(F.max("at").cast("timestamp")) - F.unix_timestamp(F.min("at").cast("timestamp"))) / 60
    return own.agg(n.alias("total_queries"), F.count(F.when(good, 1)).alias("successful_queries"), (F.count(F.when(good, 1)) / F.nullif(n, F.lit(0))).alias("success_rate"), F.avg(taken).alias("avg_execution_time"), F.min(taken).alias("min_execution_time"), F.max(taken).alias("max_execution_time"), F.coalesce(F.sum("rows_affected"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), (n / F.nullif(minutes, F.lit(0.0))).alias("queries_per_minute"))


def top_errors(records: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent error texts, trimmed and cut; ties by text."""
    text = F.substring(F.trim("error"), 1, ERROR_LENGTH).alias("error")
    return records.where("error is not null").groupBy(text).agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), "error").limit(k)


class Recorder:
    def __init__(self, max_records: int = MAX_RECORDS):
        self.attempts: deque = deque(maxlen=max_records)
        self.queries: deque = deque(maxlen=max_records)
        self._lock = threading.RLock()

    def record_attempt(self, source_type: str, method: str, duration: float, success: bool, error: str | None = None, connection_id: str | None = None, ts: datetime | None = None) -> None:
        with self._lock:
            self.attempts.append((connection_id, source_type, method, float(duration), success, error, ts or datetime.now(timezone.utc)))

    def record_query(self, query: str, duration: float, rows: int | None = None, size: int | None = None, success: bool = True, error: str | None = None, source_type: str | None = None, connection_id: str | None = None, at: datetime | None = None) -> None:
        digest = md5(query.strip().lower().encode()).hexdigest()[:12]
        with self._lock:
            self.queries.append((connection_id, source_type, digest, float(duration), rows, size, success, error, at or datetime.now(timezone.utc)))

    def attempts_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.attempts), ATTEMPT_SCHEMA)

    def queries_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.queries), QUERY_SCHEMA)

    def forget_old(self, hours: float = RETENTION_HOURS, now: datetime | None = None) -> None:
        limit = (now or datetime.now(timezone.utc)) - timedelta(hours=hours)
        with self._lock:
            for kept in (self.attempts, self.queries):
                fresh = [r for r in kept if r[-1] >= limit]
                kept.clear()
                kept.extend(fresh)

    def clear(self) -> None:
        with self._lock:
            self.attempts.clear()
            self.queries.clear()

    def export(self, form: str = "dict"):
        names = [[c.split()[0] for c in s.split(", ")] for s in (ATTEMPT_SCHEMA, QUERY_SCHEMA)]
        data = {k: [dict(zip(n, r)) for r in rows] for k, n, rows in zip(("connection_attempts", "query_executions"), names, (self.attempts, self.queries))}
        if form == "dict":
            return data
        if form == "json":
            return json.dumps(data, default=str)
        if form == "csv":
            out = io.StringIO()
            writer = csv.writer(out)
            writer.writerow(["kind", *names[0]])
            writer.writerows(["connection_attempt", *r] for r in self.attempts)
            writer.writerow(["kind", *names[1]])
            writer.writerows(["query_execution", *r] for r in self.queries)
            return out.getvalue()
        raise ValueError(f"Unsupported export format: {form}")


_shared = Recorder()


def shared_recorder() -> Recorder:
    return _shared
