"""Kinds of sources by name, and named sources of a session."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from .config import ALIASES, Config
from .source import CatalogSource, CsvSource, ParquetSource, RemoteSource, Source

KINDS: dict[str, type[Source]] = {"parquet": ParquetSource, "csv": CsvSource, "table": CatalogSource, **dict.fromkeys(("postgresql", "mysql", "snowflake", "bigquery", "databricks", "jdbc"), RemoteSource)}


def register_kind(name: str, kind: type[Source]) -> None:
    if not (isinstance(kind, type) and issubclass(kind, Source)):
        raise ValueError("a kind of source is a subclass of Source")
    KINDS[name.lower()] = kind


def supported() -> list[str]:
    return sorted([*KINDS, *ALIASES])


def open_source(spark: SparkSession, config: Config, **options) -> Source:
    if config.system not in KINDS:
        raise ValueError(f"Unsupported data source: {config.system}")
    return KINDS[config.system](spark, config, **options)


class Sources:
    """Named sources. They hold no connections, so none expire."""

    def __init__(self, spark: SparkSession):
        self.spark, self._own, self._made = spark, {}, {}

    def create(self, name: str, config: Config, **options) -> Source:
        if name in self._own:
            raise ValueError(f"Source {name!r} already exists")
        self._own[name], self._made[name] = open_source(self.spark, config, **options), time.time()
        return self._own[name]

    def get(self, name: str) -> Source | None:
        return self._own.get(name)

    def remove(self, name: str) -> bool:
        found = self._own.pop(name, None)
        self._made.pop(name, None)
        if found:
            found.close()
        return found is not None

    def list(self) -> list[str]:
        return list(self._own)

    def test(self, name: str, table: str | None = None) -> bool:
        found = self._own.get(name)
        try:
            return bool(found) and found.test(table)
        except Exception as e:  # a source that fails its test is reported, not raised
            found.recorder.record_attempt(found.config.system, "test", 0.0, False, str(e))
            return False

    def reconnect(self, name: str) -> Source:
        old = self._own[name]
        self._own[name] = open_source(self.spark, old.config, recorder=old.recorder)
        return self._own[name]

    def metrics(self) -> dict:
        by: dict[str, int] = {}
        for s in self._own.values():
            by[s.config.system] = by.get(s.config.system, 0) + 1
        return {"total": len(self._own), "by_system": by, "age_seconds": {n: time.time() - t for n, t in self._made.items()}}

    def close_all(self) -> None:
        for name in self.list():
            self.remove(name)


_shared: Sources | None = None


def shared_sources(spark: SparkSession) -> Sources:
    global _shared
    if _shared is None or _shared.spark is not spark:
        _shared = Sources(spark)
    return _shared
