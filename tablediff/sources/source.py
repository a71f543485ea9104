"""Sources: files, catalog tables and remote systems, each giving frames, metadata, lists and samples."""

from __future__ import annotations

import csv
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from string import Formatter

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import dialect, hashes_sql
from ..functions.names import IDENTIFIER_CASE, check_identifier, column, quote_identifier, split_name, sql_literal
from ..functions.types import from_spark, map_type
from ..metrics import Recorder, shared_recorder
from ..operators.sample import sample, sampling_sql
from ..operators.schema import mark_primary_keys
from .config import DEFAULT_PORTS, Config, reader_options

# File endings, dialect defaults and null marks of delimited files.
PARQUET_ENDINGS, CSV_ENDINGS = (".parquet", ".pq"), (".csv", ".tsv", ".txt")
CSV_DEFAULTS = {"sep": ",", "encoding": "utf-8", "header": True, "quote": '"'}
NULL_MARKS = ("", "NA", "NULL", "null", "None")
SNIFF_BYTES, DELIMITERS = 8192, ",;\t|"
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast", "mysql", "performance_schema", "sys")


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    data_type: str
    nullable: bool = True
    is_primary_key: bool = False
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    default_value: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class TableInfo:
    name: str
    schema: str | None
    columns: list[ColumnInfo]
    row_count: int | None = None
    size_bytes: int | None = None
    last_modified: object = None
    partitions: list[str] = field(default_factory=list)
    indexes: dict[str, list[str]] = field(default_factory=dict)

    @property
    def primary_keys(self) -> list[str]:
        return [c.name for c in self.columns if c.is_primary_key]


def columns_of(df: DataFrame) -> list[ColumnInfo]:
    kind = lambda t, n: getattr(t, n, None) if type(t).__name__ == "DecimalType" else None
    return [ColumnInfo(f.name, from_spark(f.dataType), f.nullable, bool(f.metadata.get("primary_key")), precision=kind(f.dataType, "precision"), scale=kind(f.dataType, "scale"), description=f.metadata.get("comment")) for f in df.schema]


class Source:
    """What every source does. Nothing stays open between calls, so close only forgets."""

    def __init__(self, spark: SparkSession, config: Config, recorder: Recorder | None = None, retries: int = 3, delay: float = 1.0, backoff: float = 2.0):
        self.spark, self.config = spark, config.validate()
        self.recorder = recorder or shared_recorder()
        self.retries, self.delay, self.backoff = retries, delay, backoff

    def table(self, name: str) -> DataFrame:
        raise NotImplementedError

    def list_tables(self, schema: str | None = None) -> list[str]:
        raise NotImplementedError

    def list_schemas(self) -> list[str]:
        return []

    def attempt(self, name: str, call: Callable):
        """call, again after a growing delay while reading fails; each attempt is recorded. Errors of analysis are not retried."""
        wait = self.delay
        for left in range(self.retries, -1, -1):
            began = time.time()
            try:
                out = call()
                self.recorder.record_attempt(self.config.system, name, time.time() - began, True)
                return out
            except Exception as e:
                self.recorder.record_attempt(self.config.system, name, time.time() - began, False, str(e))
                if isinstance(e, (AnalysisException, ValueError, FileNotFoundError)) or not left:
                    raise
                time.sleep(wait)
                wait *= self.backoff

    def first_that_works(self, ways: list[tuple[str, Callable]]) -> DataFrame:
        """The first reader that can be analysed, in order."""
        told = []
        for name, call in ways:
            try:
                df = self.attempt(name, call)
                df.schema  # noqa: B018  analysis is what fails
                return df
            except Exception as e:  # the next way may work; all reasons are told if none does
                told.append(f"{name}: {str(e).splitlines()[0]}")
        raise ConnectionError("No method works; " + "; ".join(told))

    def query(self, sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
        """SQL over frames named in braces, with bound parameters :name."""
        began = time.time()
        df = self.spark.sql(sql, args=args, **frames) if args else self.spark.sql(sql, **frames)
        self.recorder.record_query(sql, time.time() - began, source_type=self.config.system)
        return df

    def row_count(self, name: str) -> int:
        return self.table(name).count()

    def sample(self, name: str, n: int = 100, seed: int | None = None) -> DataFrame:
        return sample(self.table(name), n, self.config.system if self.config.system in ("postgresql", "snowflake", "mysql", "bigquery", "databricks") else None, seed)

    def test(self, name: str | None = None) -> bool:
        (self.table(name).limit(1) if name else self.spark.sql("select 1")).collect()
        return True

    def metadata(self, name: str, count: bool = True) -> TableInfo:
        df = self.table(name)
        schema, table = split_name(name) if "/" not in name else (None, name)
        return TableInfo(table, schema, columns_of(df), df.count() if count else None, self._size(df))

    def _size(self, df: DataFrame) -> int | None:
        sizes = [self._status(p).getLen() for p in df.inputFiles()]
        return sum(sizes) if sizes else None

    def _status(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(p)

    def close(self) -> None:
        pass

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.config.system}, {self.config.host or self.config.path or self.config.url or 'session'})"


class FileSource(Source):
    """A file or a folder, in any store that Spark reads. In a folder each file's stem is a table."""

    endings: tuple[str, ...] = ()

    def files(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.config.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            raise FileNotFoundError(self.config.path)
        if fs.getFileStatus(p).isFile():
            if not self.config.path.lower().endswith(self.endings):
                raise ValueError(f"{self.config.path} does not end in one of {self.endings}")
            return [self.config.path]
        found, each = [], fs.listFiles(p, True)
        while each.hasNext():
            path = each.next().getPath().toString()
            if path.lower().endswith(self.endings) and not path.rsplit("/", 1)[1].startswith(("_", ".")):
                found.append(path)
        if not found:
            raise ValueError(f"no files of {self.endings} under {self.config.path}")
        return sorted(found)

    def stem(self, path: str) -> str:
        return path.rsplit("/", 1)[1].rsplit(".", 1)[0]

    def list_tables(self, schema: str | None = None) -> list[str]:
        return sorted({self.stem(f) for f in self.files()})

    def chosen(self, name: str | None) -> list[str]:
        """Files of the stem, else the first whose name holds it, else all."""
        files = self.files()
        if not name:
            return files
        exact = [f for f in files if self.stem(f).lower() == name.lower()]
        return exact or [f for f in files if name.lower() in f.rsplit("/", 1)[1].lower()][:1] or files

    def table(self, name: str | None = None) -> DataFrame:
        return self.attempt("native", lambda: self.load(self.chosen(name)))

    def query(self, sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
        """As Source.query; {name} for a table of this source needs no frame."""
        named = {f for _, f, _, _ in Formatter().parse(sql) if f}
        own = {t: self.table(t) for t in self.list_tables() if t in named - frames.keys()}
        return super().query(sql, args, **own, **frames)

    def load(self, files: list[str]) -> DataFrame:
        raise NotImplementedError


class ParquetSource(FileSource):
    endings = PARQUET_ENDINGS

    def load(self, files: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", str(bool(self.config.extra.get("merge_schema", False))).lower()).parquet(*files)


class CsvSource(FileSource):
    endings = CSV_ENDINGS

    def dialect(self, path: str) -> dict:
        """Options for a file: the defaults, then what its head shows, then what the caller set."""
        x = self.config.extra
        own = {k: v for k, v in {"sep": x.get("separator"), "encoding": x.get("encoding"), "header": x.get("header"), "quote": x.get("quotechar")}.items() if v is not None}
        if "sep" in own:
            return CSV_DEFAULTS | own
        if path.lower().endswith(".tsv"):
            return CSV_DEFAULTS | {"sep": "\t"} | own
        head = "\n".join(r.value for r in self.spark.read.text(path).limit(50).collect())[:SNIFF_BYTES]
        try:
            return CSV_DEFAULTS | {"sep": csv.Sniffer().sniff(head, DELIMITERS).delimiter} | own
        except csv.Error:
            return CSV_DEFAULTS | own

    def spans_lines(self, options: dict, files: list[str]) -> bool:
        """Whether a quoted value goes on over a line end, as the caller says or else as an odd number of quotes in a line tells; only then is a file read by one task."""
        if "multi_line" in self.config.extra:
            return bool(self.config.extra["multi_line"])
        quotes = F.length("value") - F.length(F.replace("value", F.lit(options["quote"]), F.lit("")))
        return not self.spark.read.option("encoding", options["encoding"]).text(files).where(quotes % 2 == 1).isEmpty()

    def load(self, files: list[str]) -> DataFrame:
        """Each file by its own dialect and header. Files are texts at first, put together by column name; types are inferred once, from all rows of all files; null marks are nulls."""
        groups: dict[tuple, list[str]] = {}
        for f in files:
            options = self.dialect(f)
            header = self.spark.read.options(**options, escape='"').csv(f).columns
            groups.setdefault((tuple(sorted(options.items())), tuple(header)), []).append(f)
        marks = tuple(self.config.extra.get("na_values", NULL_MARKS))
        parts = []
        for (options, header), own in groups.items():
            texts = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
            raw = self.spark.read.schema(texts).options(**dict(options), multiLine=self.spans_lines(dict(options), own), escape='"').csv(own)
            parts.append(raw.select(*[F.when(F.trim(column(c)).isin(*marks), None).otherwise(column(c)).alias(c) for c in raw.columns]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return infer_types(out)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns as the narrowest of long, decimal(38,0), double, boolean, date or timestamp that holds all their values as they are, text where numbers have leading zeros or more digits: one aggregation for all columns."""
    kinds = ("bigint", "decimal(38,0)", "double", "boolean", "date", "timestamp")
    tests = []
    for i, c in enumerate(df.columns):
        value = column(c)
        for k in kinds:
            ok = value.try_cast(k).isNotNull()
            if k in kinds[:3]:  # 007 and 7 are not one id
                ok = ok & ~value.rlike(r"^\s*[+-]?0\d")
            if k == "decimal(38,0)":
                ok = ok & value.rlike(r"^\s*[+-]?\d{1,38}\s*$")
            elif k == "double":  # which would make one number of two with more digits
                ok = ok & ~value.rlike(r"^\s*[+-]?\d{16,}\s*$")
            if k == "boolean":
                ok = F.lower(value).isin("true", "false")
            elif k == "date":
                ok = ok & value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
            elif k == "timestamp":
                ok = ok & value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d")
            tests.append(F.bool_and(F.when(value.isNotNull(), ok)).alias(f"{i}_{k}"))
    if not tests:
        return df
    held = df.agg(*tests).first()
    pick = lambda i: next((k for k in kinds if held[f"{i}_{k}"]), "string")
    return df.select(*[column(c).try_cast(pick(i)).alias(c) for i, c in enumerate(df.columns)])


class CatalogSource(Source):
    """Tables and views of the session's catalogs."""

    def table(self, name: str) -> DataFrame:
        return self.attempt("catalog", lambda: self.spark.table(name))

    def list_tables(self, schema: str | None = None) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(schema or self.spark.catalog.currentDatabase()))

    def list_schemas(self) -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases() if d.name.lower() not in SYSTEM_SCHEMAS)


class RemoteSource(Source):
    """A system that Spark reads through a connector or JDBC driver. Filters, columns and limits are pushed to it by the reader."""

    def _load(self, split: dict | None = None, **what) -> DataFrame:
        form, options = reader_options(self.config, **what)
        options |= split or {}
        ways = [(form, lambda: self.spark.read.format(form).options(**options).load())]
        if form != "jdbc" and self.config.url:  # a connector of its own first, then the driver
            also = reader_options(Config("jdbc", url=self.config.url, username=self.config.username, password=self.config.password, extra=self.config.extra), **what)[1]
            ways.append(("jdbc", lambda: self.spark.read.format("jdbc").options(**also).load()))
        return self.first_that_works(ways) if len(ways) > 1 else self.attempt(*ways[0])

    def table(self, name: str) -> DataFrame:
        """The table, read in parts by its key where bounds are known: those of the settings, else the least and greatest value of a single whole-number key."""
        keys = self.config.extra.get("primary_keys", {}).get(name)
        df = self._load(table=name, split=self._split(name, keys))
        return mark_primary_keys(df, keys) if keys else df

    def _named(self, name: str) -> str:
        """A checked name, quoted as the system quotes."""
        return quote_identifier(name, IDENTIFIER_CASE.get(self.config.system, "preserve"), "`" if self.config.system in ("mysql", "bigquery", "databricks") else '"')

    def _split(self, name: str, keys: list[str] | None) -> dict:
        parts = int(self.config.extra.get("parts", 0))
        if parts < 2 or not keys or len(keys) != 1 or "partitionColumn" in self.config.extra:
            return {}
        key = check_identifier(keys[0])
        low, high = self.remote_query(f"select min({self._named(key)}) as low, max({self._named(key)}) as high from {self._named(name)}").first()
        if not isinstance(low, int) or not isinstance(high, int):
            return {}
        return {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}

    def sample(self, name: str, n: int = 100, seed: int | None = None) -> DataFrame:
        """Drawn by the system itself where it has a way, so that only the sample is sent."""
        if self.config.system in DEFAULT_PORTS or self.config.system in ("snowflake", "bigquery", "databricks"):
            return self.remote_query(sampling_sql(self._named(name), n, self.config.system))
        return super().sample(name, n, seed)

    def metadata(self, name: str, count: bool = True) -> TableInfo:
        """Columns, keys, indexes, rows and size from the system's own catalog, where it has one; else what the reader shows."""
        if self.config.system not in CATALOG_SQL:
            df = self.table(name)
            schema, table = split_name(name)
            return TableInfo(table, schema, columns_of(df), df.count() if count else None)
        schema, table = split_name(check_identifier(name))
        schema = schema or self.config.schema or ("public" if self.config.system == "postgresql" else self.config.database)
        ask = lambda what: [{k.lower(): v for k, v in r.asDict().items()} for r in self._information(CATALOG_SQL[self.config.system][what].format(schema=sql_literal(schema), table=sql_literal(table)))]
        keys = {r["column_name"] for r in ask("keys")}
        indexes: dict[str, list[str]] = {}
        for r in sorted(ask("indexes"), key=lambda r: (r["index_name"], r["seq_in_index"])):
            indexes.setdefault(r["index_name"], []).append(r["column_name"])
        size = ask("size")
        rows = self.remote_query(f"select count(*) as n from {self._named(name)}").first()[0] if count else (size[0]["row_estimate"] if size else None)
        return TableInfo(table, schema, columns_from_catalog(self.config.system, ask("columns"), keys), rows, size[0]["size_bytes"] if size else None, indexes=indexes)

    def dialect(self) -> str:
        """The name of the SQL that the system speaks; for a plain JDBC source its URL tells."""
        return self.config.url.split(":")[1] if self.config.system == "jdbc" else self.config.system

    def quoted(self, name: str) -> str:
        """A table's checked name in the system's own quotes."""
        check_identifier(name)
        return ".".join(dialect(self.dialect()).named(part) for part in name.split("."))

    def hashes(self, name: str, keys: list[str], columns: list[str] | dict[str, str]) -> DataFrame:
        """Keys and a hash of the columns (their common types, or text if none are given), made by the system itself, so that no other value is sent. Null and empty differ, and values cannot run together."""
        system = self.dialect()
        kinds = columns if isinstance(columns, dict) else dict.fromkeys(columns, "string")
        return self.remote_query(hashes_sql(system, self._named, keys, kinds, self._named(name)))

    def rows_where(self, name: str, predicates: list[str]) -> DataFrame:
        """The rows that meet one of the predicates, which exclude each other: over JDBC each is a statement and a task of its own."""
        form, options = reader_options(self.config, table=self.quoted(name))
        if form == "jdbc":
            table, url = options.pop("dbtable"), options.pop("url")
            return self.attempt("predicates", lambda: self.spark.read.jdbc(url, table, predicates=predicates, properties={k: v for k, v in options.items() if k != "numPartitions"}))
        parts = [self.remote_query(f"select * from {self.quoted(name)} where {p}") for p in predicates]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def remote_query(self, sql: str) -> DataFrame:
        return self._load(query=sql)

    def _information(self, sql: str) -> list:
        return self.remote_query(sql).collect()

    def list_tables(self, schema: str | None = None) -> list[str]:
        own = schema or self.config.schema or self.config.database
        return sorted(r[0] for r in self._information(f"select table_name from information_schema.tables where table_schema = {sql_literal(own)} and table_type = 'BASE TABLE'"))

    def list_schemas(self) -> list[str]:
        return sorted(r[0] for r in self._information("select schema_name from information_schema.schemata") if r[0].lower() not in SYSTEM_SCHEMAS)


def columns_from_catalog(system: str, rows: list[dict], keys: set[str] = frozenset()) -> list[ColumnInfo]:
    """Columns from the rows of a system's own catalog, names in upper or lower case."""
    out = []
    for row in rows:
        r = {k.lower(): v for k, v in row.items()}
        native = str(r.get("data_type"))
        nullable = r.get("is_nullable") if "is_nullable" in r else r.get("nullable")
        out.append(ColumnInfo(r["column_name"], map_type(system, native), str(nullable).upper() in ("YES", "Y", "TRUE"), r["column_name"] in keys or r.get("column_key") == "PRI" or bool(r.get("is_primary_key")), r.get("character_maximum_length"), r.get("numeric_precision"), r.get("numeric_scale"), r.get("column_default"), r.get("comment") or r.get("column_comment")))
    return out


_COLUMNS = "select column_name, data_type, is_nullable, character_maximum_length, numeric_precision, numeric_scale, column_default from information_schema.columns where table_schema = {schema} and table_name = {table} order by ordinal_position"
_KEYS = "select k.column_name from information_schema.table_constraints c join information_schema.key_column_usage k on k.constraint_name = c.constraint_name and k.table_schema = c.table_schema and k.table_name = c.table_name where c.constraint_type = 'PRIMARY KEY' and c.table_schema = {schema} and c.table_name = {table}"
#: By system: what its catalog knows of a table.
CATALOG_SQL = {
    "postgresql": {
        "columns": _COLUMNS,
        "keys": _KEYS,
        "indexes": "select i.relname as index_name, p.n as seq_in_index, a.attname as column_name from pg_index x join pg_class i on i.oid = x.indexrelid join pg_class t on t.oid = x.indrelid join pg_namespace s on s.oid = t.relnamespace cross join lateral unnest(x.indkey) with ordinality as p(attnum, n) join pg_attribute a on a.attrelid = t.oid and a.attnum = p.attnum where s.nspname = {schema} and t.relname = {table}",
        "size": "select cast(t.reltuples as bigint) as row_estimate, pg_total_relation_size(t.oid) as size_bytes from pg_class t join pg_namespace s on s.oid = t.relnamespace where s.nspname = {schema} and t.relname = {table}",
    },
    "mysql": {
        "columns": _COLUMNS,
        "keys": _KEYS,
        "indexes": "select index_name, seq_in_index, column_name from information_schema.statistics where table_schema = {schema} and table_name = {table}",
        "size": "select table_rows as row_estimate, data_length + index_length as size_bytes from information_schema.tables where table_schema = {schema} and table_name = {table}",
    },
}
