"""Comparison that runs inside the systems that hold the tables: only digests or sums of segments are sent, and then the rows that differ.

HASH_DIFF: each system sends its keys with a digest of the other columns, made from canonical texts; Spark joins them, writes the
keys that differ, and asks both systems for the rows of these alone, in batches of BATCH keys that are predicates of the statement. Over FETCH_KEYS of them the
tables are read whole. Values without a canonical text in one of the systems are sent beside the digest and compared as they are.

BISECTION: each system groups its rows by ranges of a whole-number key and sends a count and a sum of digests for each range, all ranges of
a level in one statement; Spark compares the sums, and only ranges that differ are cut again, until they have few rows.
The rows of these ranges are then read. Null keys and keys beyond the bounds are ranges of their own.

A side is a table of a RemoteSource or a DataFrame; the latter takes part with the same SQL.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import WHOLE, canonical, dialect, digest_number, hashes_sql, literal, row_digest
from ..functions.names import common_columns, non_keys, resolve
from ..functions.types import from_spark
from ..scratch import stored
from .diff import aligned, classify, pair_off
from .model import Algorithm, DiffRun
from .schema import compare_schemas

#: Keys of one predicate; differing keys up to which rows are asked for by key; rows of a range that is not cut again; ranges of a level.
BATCH, FETCH_KEYS, SMALL_RANGE, MOST_RANGES = 200, 20_000, 100, 400


@dataclass
class Side:
    """A table and how to ask for it: sql has {t} for the table."""

    system: str
    schema: T.StructType
    ask: object = field(repr=False)
    parts: object = field(repr=False)

    @classmethod
    def of(cls, table) -> Side:
        if isinstance(table, DataFrame):
            spark, view = table.sparkSession, table
            ask = lambda sql: spark.sql(sql, t=view)
            return cls("databricks", table.schema, ask, lambda where: ask(f"select * from {{t}} where {' or '.join(f'({w})' for w in where)}"))
        source, name = table
        return cls(source.dialect(), source.table(name).schema, lambda sql: source.remote_query(sql.format(t=source.quoted(name))), lambda where: source.rows_where(name, where))

    def name(self, column_name: str) -> str:
        return dialect(self.system).named(column_name)

    def count(self) -> int:
        return self.ask("select count(*) as n from {t}").first()[0]

    def hashes(self, keys: list[str], kinds: dict[str, str]) -> DataFrame:
        """Keys and row_hash, a digest of the columns in kinds (their common types), made by the system."""
        return self.ask(hashes_sql(self.system, self.name, keys, kinds, "{t}"))


class RemoteDiff:
    """As TableDiff for tables of which one or both stay in their system. source and target: (RemoteSource, table) or a DataFrame."""

    def __init__(self, source, target, keys, target_keys=None, *, duplicates: str = "multiset", null_keys: str = "equal", segment_key: str | None = None):
        self.a, self.b = Side.of(source), Side.of(target)
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.target_keys = self.keys if target_keys is None else [target_keys] if isinstance(target_keys, str) else list(target_keys)
        if duplicates not in ("multiset", "fanout") or null_keys not in ("equal", "sql"):
            raise ValueError("duplicates is multiset or fanout, null_keys is equal or sql")
        self.null_safe, self.whole = null_keys == "equal", pair_off if duplicates == "multiset" else classify
        self.segment_key = segment_key
        self._plan()

    def _plan(self) -> None:
        """Keys, the columns that are digested (with the scale of both sides' decimals) and those that are sent."""
        names_a, names_b = self.a.schema.names, self.b.schema.names
        ka, kb = [resolve(k, names_a) for k in self.keys], [resolve(k, names_b) for k in self.target_keys]
        if not ka or len(ka) != len(kb):
            raise ValueError("both sides need the same number of keys, at least one")
        self.key_pairs = list(zip(ka, kb))
        self.digested, self.sent = [], []
        for x, y in common_columns(names_a, names_b):
            if x not in non_keys(names_a, ka) or y not in non_keys(names_b, kb):
                continue
            kinds = [from_spark(s.schema[n].dataType) for s, n in ((self.a, x), (self.b, y))]
            scales = [getattr(s.schema[n].dataType, "scale", 0) or 0 if k == "decimal" else 0 for s, n, k in ((self.a, x, kinds[0]), (self.b, y, kinds[1]))]
            kind = kinds[0] if kinds[0] == kinds[1] else "int64" if all(k in WHOLE for k in kinds) else "decimal" if all(k in (*WHOLE, "decimal") for k in kinds) else None
            texts = [kind and canonical(s.system, kind, s.name(n), max(scales)) for s, n in ((self.a, x), (self.b, y))]
            if all(texts):
                self.digested.append((x, y, texts))
            else:
                self.sent.append((x, y))

    def _digest(self, i: int) -> str:
        return row_digest((self.a, self.b)[i].system, [t[i] for _, _, t in self.digested])

    def _narrow(self, i: int) -> DataFrame:
        """Keys, what is sent, and the digest, under the source's names."""
        side = (self.a, self.b)[i]
        pairs = self.key_pairs + self.sent
        named = ", ".join(side.name(p[i]) for p in pairs)
        found = side.ask(f"select {named}, {self._digest(i)} as {side.name('ROW_DIGEST')} from {{t}}")
        return found.toDF(*[p[0] for p in pairs], "ROW_DIGEST")

    def compare(self, algorithm: Algorithm | str = Algorithm.HASH_DIFF, **options) -> DiffRun:
        began, algorithm = time.time(), Algorithm(algorithm)
        run = DiffRun(algorithm, [a for a, _ in self.key_pairs], schema_differences=compare_schemas(*(SparkSession.active().createDataFrame([], s.schema) for s in (self.a, self.b))))
        run.common_columns = run.keys + [x for x, *_ in self.digested] + [x for x, _ in self.sent]
        try:
            if algorithm is Algorithm.HASH_DIFF:
                run.rows, run.metadata = self._hash_diff(**options)
            elif algorithm is Algorithm.BISECTION:
                run.rows, run.metadata = self._bisect(**options)
            else:
                raise ValueError("HASH_DIFF and BISECTION run inside the systems; read the tables for others")
        except ValueError as e:
            run.error = str(e)
        run.execution_time_seconds = time.time() - began
        return run

    def _rows(self, where: tuple[list[str], list[str]] | None) -> DataFrame:
        """The rows of both sides that meet one of the predicates, compared; all rows without predicates."""
        a, b = ((s.parts(w) if w else s.ask("select * from {t} where 1 = 0")) if where else s.ask("select * from {t}") for s, w in zip((self.a, self.b), where or (None, None)))
        left, right, keys, values = aligned(a, b, [x for x, _ in self.key_pairs], [y for _, y in self.key_pairs])
        return self.whole(left, right, keys, values, self.null_safe)

    def _hash_diff(self, fetch_keys: int = FETCH_KEYS) -> tuple[DataFrame, dict]:
        left, right, keys, values = aligned(self._narrow(0), self._narrow(1), [x for x, _ in self.key_pairs], [x for x, _ in self.key_pairs])
        found = self.whole(left, right, keys, values, self.null_safe).select("key", (F.col("status") == "matched").alias("same"))
        by_key = found.groupBy("key").agg(F.bool_and("same").alias("same"), F.count("*").alias("n"))
        # rows of keys without a difference are counted on the way
        from pyspark.sql import Observation

        seen = Observation()
        wrong = stored(by_key.observe(seen, F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("same")).where("not same").select("key.*"), "remote-keys")
        few = wrong.limit(fetch_keys + 1).collect()
        meta = {"rows_in_equal_segments": seen.get["same"] or 0, "keys_differing": len(few)}
        if len(few) > fetch_keys:
            whole = self._rows(None)
            names = wrong.toDF(*[f"__w{i}" for i in range(len(keys))])
            on = reduce(lambda x, y: x & y, [F.col(f"__w{i}").eqNullSafe(F.col(f"key.`{k}`")) for i, k in enumerate(keys)])
            return whole.join(names, on, "left_semi"), meta | {"read": "tables", "keys_differing": wrong.count()}
        where = tuple(_by_keys(s, [p[i] for p in self.key_pairs], [tuple(r) for r in few]) for i, s in enumerate((self.a, self.b)))
        return self._rows(where), meta | {"read": "keys", "statements": len(where[0]) + len(where[1])}

    def _bisect(self, segments: int = 16, threshold: int = SMALL_RANGE, max_depth: int = 12) -> tuple[DataFrame, dict]:
        if self.sent:
            raise ValueError(f"columns without a canonical text in both systems cannot be summed there: {', '.join(x for x, _ in self.sent)}")
        pairs = dict(self.key_pairs)
        key = resolve(self.segment_key, list(pairs)) if self.segment_key else self.key_pairs[0][0]
        names = key, pairs[key]
        kinds = [from_spark(s.schema[n].dataType) for s, n in zip((self.a, self.b), names)]
        if not all(k in WHOLE for k in kinds):
            raise ValueError(f"{key} is not a whole number on both sides; HASH_DIFF takes any key")
        ends = [s.ask(f"select min({s.name(n)}) as low, max({s.name(n)}) as high from {{t}}").first() for s, n in zip((self.a, self.b), names)]
        known = [int(x) for r in ends for x in r if x is not None]
        ranges = [(None, None)] + ([(min(known), max(known) + 1)] if known else [])  # null keys are a range of their own
        leaves, equal, depth, compared, sums_read = [], 0, 0, 0, 0
        while ranges:
            cut = ranges if not depth else [piece for low, high in ranges for piece in _pieces(low, high, segments)]
            sums = [self._sums(i, names[i], cut) for i in (0, 1)]
            compared, sums_read = compared + len(cut), sums_read + sum(map(len, sums))
            wrong = []
            for j, piece in enumerate(cut):
                x, y = (s.get(j, (0, 0)) for s in sums)
                if x == y:
                    equal += x[0]
                else:
                    wrong.append((piece, max(x[0], y[0]), x[0], y[0]))
            depth += bool(wrong)
            again = [w for w in wrong if w[0][0] is not None and w[1] > threshold and w[0][1] - w[0][0] > 1 and depth < max_depth]
            if len(again) * segments > MOST_RANGES and depth > 1:
                again = []  # differences are everywhere: what is left is read
            taken = {w[0] for w in again}
            leaves += [w for w in wrong if w[0] not in taken]
            ranges = sorted(taken)
        meta = {"depth_reached": depth, "segments_compared": compared, "segments_differing": len(leaves), "rows_in_equal_segments": equal, "rows_read": sum(w[2] + w[3] for w in leaves), "sums_read": sums_read}
        where = tuple([_in_range(s, n, *w[0]) for w in leaves] for s, n in zip((self.a, self.b), names))
        return self._rows(where), meta

    def _sums(self, i: int, key: str, ranges: list[tuple]) -> dict[int, tuple]:
        """Place of a range to the count and the sum of digests of its rows; a row for each range is sent."""
        side = (self.a, self.b)[i]
        whens = " ".join(f"when {_in_range(side, key, *r)} then {j}" for j, r in enumerate(ranges))
        texts = [t[i] for _, _, t in self.digested]
        own = [canonical(side.system, self._key_kind(p), side.name(p[i])) for p in self.key_pairs]
        h = digest_number(side.system, row_digest(side.system, own + texts))
        wide = "bignumeric" if side.system == "bigquery" else f"decimal({dialect(side.system).digits}, 0)"
        seg, n, total = (side.name(x) for x in ("SEG", "N", "TOTAL"))
        inner = f"select case {whens} end as {seg}, {h} as {side.name('H')} from {{t}} where {' or '.join(_in_range(side, key, *r) for r in ranges)}"
        found = side.ask(f"select {seg}, count(*) as {n}, sum(cast({side.name('H')} as {wide})) as {total} from ({inner}) x group by {seg}").collect()
        return {int(r[0]): (int(r[1]), int(r[2])) for r in found}

    def _key_kind(self, pair: tuple[str, str]) -> str:
        kinds = [from_spark(s.schema[n].dataType) for s, n in zip((self.a, self.b), pair)]
        kind = "int64" if all(k in WHOLE for k in kinds) else kinds[0]
        if kinds[0] != kinds[1] and kind != "int64" or any(canonical(s.system, kind, "x") is None for s in (self.a, self.b)):
            raise ValueError(f"key {pair[0]} has no canonical text in both systems")
        return kind


def _pieces(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """At most n ranges from low to under high, of one width but for the last."""
    width = -(-(high - low) // n)
    return [(x, min(x + width, high)) for x in range(low, high, width)]


def _in_range(side: Side, key: str, low: int | None, high: int | None) -> str:
    name = side.name(key)
    return f"{name} is null" if low is None else f"({name} >= {low} and {name} < {high})"


def _by_keys(side: Side, names: list[str], keys: list[tuple]) -> list[str]:
    """Predicates for the rows with these keys, BATCH keys each."""
    named = [side.name(n) for n in names]
    out = []
    for at in range(0, len(keys), BATCH):
        part = keys[at : at + BATCH]
        if len(named) == 1:
            some = ", ".join(literal(side.system, k[0]) for k in part if k[0] is not None)
            where = ([f"{named[0]} in ({some})"] if some else []) + ([f"{named[0]} is null"] if any(k[0] is None for k in part) else [])
        else:
            where = ["(" + " and ".join(f"{n} is null" if v is None else f"{n} = {literal(side.system, v)}" for n, v in zip(named, k)) + ")" for k in part]
        out.append(" or ".join(where))
    return out
