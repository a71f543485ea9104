"""Enumerations and results."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults of the comparison.
MAX_DETAIL_ROWS, ROW_LIMIT_WARNING, SEGMENTS, SEGMENT_THRESHOLD, SUGGEST_SEGMENTS_ABOVE = 100, 100_000, 16, 1000, 1_000_000


class Status(str, Enum):
    ADDED, DELETED, MODIFIED, MATCHED = "added", "deleted", "modified", "matched"


class Algorithm(str, Enum):
    JOIN_DIFF, CROSS_DB_DIFF, HASH_DIFF, BISECTION, SKETCH_DIFF, AUTO = "JOIN_DIFF", "CROSS_DB_DIFF", "HASH_DIFF", "BISECTION", "SKETCH_DIFF", "AUTO"


@dataclass(frozen=True)
class DiffSummary:
    source_rows: int
    target_rows: int
    added: int
    deleted: int
    modified: int
    matched: int

    @property
    def total_differences(self) -> int:
        return self.added + self.deleted + self.modified


@dataclass
class DiffRun:
    """The outcome of a comparison. rows is lazy; the summary runs one aggregation when it is first asked for."""

    algorithm: Algorithm
    keys: list[str]
    source_asset: str = "source"
    target_asset: str = "target"
    rows: DataFrame | None = None
    common_columns: list[str] = field(default_factory=list)
    schema_differences: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    error: str | None = None
    execution_time_seconds: float | None = None

    @cached_property
    def summary(self) -> DiffSummary | None:
        if self.rows is None:
            return None
        counts = {r["status"]: r["n"] for r in self.rows.groupBy("status").agg(F.count("*").alias("n")).collect()}
        n = {s.value: counts.get(s.value, 0) for s in Status}
        both = n["modified"] + n["matched"]
        extra = self.metadata.get("rows_in_equal_segments", 0)
        return DiffSummary(both + n["deleted"] + extra, both + n["added"] + extra, n["added"], n["deleted"], n["modified"], n["matched"] + extra)

    @property
    def match(self) -> bool:
        return self.error is None and self.summary is not None and self.summary.total_differences == 0

    @property
    def schema_match(self) -> bool:
        return not any(self.schema_differences.get(k) for k in ("columns_only_in_a", "columns_only_in_b", "different"))

    def _of(self, status: Status) -> DataFrame:
        return self.rows.where(F.col("status") == status.value)

    @property
    def differences(self) -> DataFrame:
        return self.rows.where(F.col("status") != Status.MATCHED.value)

    @property
    def added_rows(self) -> DataFrame:
        return self._of(Status.ADDED)

    @property
    def deleted_rows(self) -> DataFrame:
        return self._of(Status.DELETED)

    @property
    def modified_rows(self) -> DataFrame:
        return self._of(Status.MODIFIED)

    def detail(self, limit: int = MAX_DETAIL_ROWS) -> DataFrame:
        """The first differences by key: deleted, then added, then modified."""
        if limit > ROW_LIMIT_WARNING:
            self.warnings.append(f"{limit} rows of detail were asked for; over {ROW_LIMIT_WARNING} are better read from differences")
        order = F.when(F.col("status") == "deleted", 0).when(F.col("status") == "added", 1).otherwise(2)
        return self.differences.orderBy(order, "key").limit(limit)
