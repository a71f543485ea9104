"""Row comparison of two tables by key: join, full-value and hash strategies over one result.

Every strategy gives the same rows: key (a struct under the source's names), status, mismatched_columns,
source_values, target_values. Values are equal when both are null or equal; NaN equals NaN and 0.0 equals -0.0; columns of different
types are compared by what they stand for, as text where no type holds both.

What each costs: JOIN_DIFF and CROSS_DB_DIFF shuffle the common columns of both sides once, by key. HASH_DIFF shuffles keys and
hashes, writes the keys with their status, and reads values again only for the keys that differ, unless these are too many to
broadcast: then it shuffles like JOIN_DIFF. BISECTION (operators.bisect) moves segment sums and then only the rows of segments
that differ.

Repeated keys as multisets: rows that are equal in all columns match first, as many as both sides have; what is left of a key
pairs off in the order of its hashes. Rows are dealt out by key and hash, so a key with very many different rows is split; only what
is left is dealt by key.
"""

from __future__ import annotations

import time
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import holds_map, row_hash, text_of
from ..functions.names import column, common_columns, non_keys, resolve
from ..scratch import BROADCAST_ROWS, stored
from .model import Algorithm, DiffRun
from .schema import compare_schemas

DUPLICATES = ("multiset", "fanout", "error")


def aligned(a: DataFrame, b: DataFrame, keys_a: list[str], keys_b: list[str]) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Both sides as keys and common other columns under a's names; the keys; the other columns."""
    if len(keys_a) != len(keys_b):
        raise ValueError("Key column lists must have equal length")
    if not keys_a:
        raise ValueError("At least one key column is needed")
    pairs = common_columns(a.columns, b.columns)
    if not pairs:
        raise ValueError("No common columns found between tables")
    ka, kb = [resolve(k, a.columns) for k in keys_a], [resolve(k, b.columns) for k in keys_b]
    values = [(x, y) for x, y in pairs if x in non_keys(a.columns, ka) and y in non_keys(b.columns, kb)]
    left, right = [], []
    for x, y in [*zip(ka, kb), *values]:
        tx, ty = a.schema[x].dataType, b.schema[y].dataType
        cx, cy = _comparable(column(x), tx, ty), _comparable(column(y), ty, tx)
        left.append(cx.alias(x))
        right.append(cy.alias(x))
    return a.select(*left), b.select(*right), ka, [x for x, _ in values]


_RANK = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
_WHOLE_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _comparable(c: Column, own: T.DataType, other: T.DataType) -> Column:
    """c in a form that equals the other side's value exactly when the values are equal."""
    whole = lambda t: type(t) in _RANK
    exact = lambda t: whole(t) or isinstance(t, T.DecimalType)
    broken = lambda t: isinstance(t, (T.FloatType, T.DoubleType))
    if holds_map(own) or holds_map(other):
        return text_of(c, own)
    if own == other:
        return c
    if whole(own) and whole(other):
        return c.cast("long")
    if broken(own) and broken(other):
        return c.cast("double")
    if exact(own) and exact(other):
        # as many digits before and after the point as either side may have
        digits = lambda t: (t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (_WHOLE_DIGITS[type(t)], 0)
        before, after = (max(x) for x in zip(digits(own), digits(other)))
        return c.cast(T.DecimalType(before + after, after)) if before + after <= 38 else _plain(c.cast("string"))
    if (exact(own) or broken(own)) and (exact(other) or broken(other)):
        # neither type holds all values of the other, so both become texts without trailing zeros
        return _decimal_text(c.cast("double")) if broken(own) else _plain(c.cast("string"))
    nested = (T.ArrayType, T.StructType)
    if type(own) is type(other) and not isinstance(own, nested):
        return c
    return text_of(c, own)


def _decimal_text(c: Column) -> Column:
    """A double as a decimal's text. Whole numbers are exact; a fraction is the shortest decimal that stands for this double, if a decimal type can hold it, else no decimal's text."""
    size = F.abs(c)
    whole = (size >= F.lit(2.0**53)) | (c == F.floor(c))  # floor gives a long
    # over 2^63 a double is cut into parts that a long holds; all steps are exact, as they move the exponent alone
    high = F.floor(size / F.lit(2.0**64))
    rest = size - high.cast("double") * F.lit(2.0**64)
    middle = F.floor(rest / F.lit(2.0**32))
    wide = lambda x: x.cast("decimal(38,0)")
    exact = wide(high) * wide(F.lit(2**32)) * wide(F.lit(2**32)) + wide(middle) * wide(F.lit(2**32)) + wide(rest - middle.cast("double") * F.lit(2.0**32))
    large = F.concat(F.when(c < 0, "-").otherwise(""), exact.cast("string"))
    kept = lambda kind: c.try_cast(kind).cast("double") == c
    text = lambda kind: _plain(F.format_string("%s", c.try_cast(kind).cast("string")))
    small = F.when((size < 1) & kept("decimal(38,37)"), text("decimal(38,37)")).when(kept("decimal(38,18)"), text("decimal(38,18)")).otherwise(c.cast("string"))
    return F.when(c == 0, "0").when(whole & (size < F.lit(2.0**63)), c.cast("long").cast("string")).when(whole & (size < F.lit(1e38)), large).when(c.isNotNull(), small)


def _plain(text: Column) -> Column:
    """A decimal's text without zeros at the end of its fraction; 0 has no sign."""
    cut = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(cut == "-0", "0").otherwise(cut)


def pair_off(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], null_safe_keys: bool = True) -> DataFrame:
    """As classify, with repeated keys as multisets: equal rows match first, the rest of a key pairs off one to one."""
    packed = F.struct(*[column(c).alias(c) for c in values]) if values else F.struct(F.lit(1).alias("_"))
    side = lambda df, source: df.select(*[column(k).alias(k) for k in keys], packed.alias("__s"), F.unhex(row_hash(values, df.schema)).alias("__h"), F.lit(source).alias("__a"))
    both = side(a, True).unionByName(side(b, False))
    names = [column(k) for k in keys]
    alone = reduce(or_, [c.isNull() for c in names])
    nameless, both = both.where(alone), both if null_safe_keys else both.where(~alone)
    same = Window.partitionBy(*names, "__h")
    of = lambda source: F.sum(F.when(F.col("__a") == source, 1).otherwise(0)).over(same)
    place = F.row_number().over(Window.partitionBy(*names, "__h", "__a").orderBy("__h"))
    both = both.withColumn("__spare", place > F.least(of(True), of(False)))
    matched = both.where("__a and not __spare").select(*names, F.col("__s").alias("sa"), F.col("__s").alias("sb"))
    spare = both.where("__spare").withColumn("__n", F.row_number().over(Window.partitionBy(*names, "__a").orderBy("__h")))
    rest = spare.groupBy(*names, "__n").agg(F.first(F.when(F.col("__a"), F.col("__s")), True).alias("sa"), F.first(F.when(~F.col("__a"), F.col("__s")), True).alias("sb")).drop("__n")
    rows = matched.unionByName(rest)
    if not null_safe_keys:
        rows = rows.unionByName(nameless.select(*names, F.when(F.col("__a"), F.col("__s")).alias("sa"), F.when(~F.col("__a"), F.col("__s")).alias("sb")))
    wrong = mismatches(values)
    status = F.when(F.col("sb").isNull(), "deleted").when(F.col("sa").isNull(), "added").when(F.size(wrong) > 0, "modified").otherwise("matched")
    return rows.select(F.struct(*[column(k).alias(k) for k in keys]).alias("key"), status.alias("status"), F.when(status == "modified", wrong).otherwise(F.array().cast("array<string>")).alias("mismatched_columns"), F.col("sa").alias("source_values"), F.col("sb").alias("target_values"))


def on_keys(keys: list[str], null_safe: bool = True) -> Column:
    same = lambda k: (F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) if null_safe else F.col(f"a.`{k}`") == F.col(f"b.`{k}`"))
    return reduce(and_, [same(k) for k in keys])


def mismatches(values: list[str]) -> Column:
    """Names of the columns in which structs sa and sb differ."""
    if not values:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(~F.col(f"sa.`{c}`").eqNullSafe(F.col(f"sb.`{c}`")), F.lit(c)) for c in values]))


def classify(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], null_safe_keys: bool = True) -> DataFrame:
    """One full outer join. Presence comes from markers, not from keys, so null keys are placed rightly."""
    pack = lambda df, s, m: df.select(*[column(k) for k in keys], (F.struct(*[column(c).alias(c) for c in values]) if values else F.struct(F.lit(1).alias("_"))).alias(s), F.lit(True).alias(m))
    left, right = pack(a, "sa", "ina").alias("a"), pack(b, "sb", "inb").alias("b")
    joined = left.join(right, on_keys(keys, null_safe_keys), "full_outer")
    wrong = mismatches(values)
    status = F.when(F.col("inb").isNull(), "deleted").when(F.col("ina").isNull(), "added").when(F.size(wrong) > 0, "modified").otherwise("matched")
    key = F.struct(*[F.when(F.col("ina").isNotNull(), F.col(f"a.`{k}`")).otherwise(F.col(f"b.`{k}`")).alias(k) for k in keys])
    return joined.select(key.alias("key"), status.alias("status"), F.when(status == "modified", wrong).otherwise(F.array().cast("array<string>")).alias("mismatched_columns"), F.col("sa").alias("source_values"), F.col("sb").alias("target_values"))


def hash_candidates(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], null_safe_keys: bool = True) -> DataFrame:
    """Keys with their status, from keys and hashes alone."""
    narrow = lambda df, h: df.select(*[column(k) for k in keys], row_hash(values, df.schema).alias(h))
    left, right = narrow(a, "ha").alias("a"), narrow(b, "hb").alias("b")
    joined = left.join(right, on_keys(keys, null_safe_keys), "full_outer")
    status = F.when(F.col("hb").isNull(), "deleted").when(F.col("ha").isNull(), "added").when(F.col("ha") != F.col("hb"), "modified").otherwise("matched")
    return joined.select(*[F.when(F.col("ha").isNotNull(), F.col(f"a.`{k}`")).otherwise(F.col(f"b.`{k}`")).alias(k) for k in keys], status.alias("status"))


def hash_groups(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Each key with status matched and the number of its rows (n), or with status modified if the multisets of its hashes differ. Counts are combined before the shuffles."""
    narrow = lambda df, name, other: df.select(*[column(k).alias(k) for k in keys], row_hash(values, df.schema).alias("__h"), F.lit(1).alias(name), F.lit(0).alias(other))
    both = narrow(a, "na", "nb").unionByName(narrow(b, "nb", "na"))
    each = both.groupBy(*[column(k) for k in keys], "__h").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    found = each.groupBy(*[column(k) for k in keys]).agg(F.bool_and(F.col("na") == F.col("nb")).alias("same"), F.sum("na").alias("n"))
    return found.select(*[column(k) for k in keys], F.when(F.col("same"), "matched").otherwise("modified").alias("status"), "n")


def with_keys(df: DataFrame, wanted: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """The rows of df whose key is in wanted, null keys too; with left_anti those whose key is not."""
    named = wanted.select(*[column(k).alias(f"__w{i}") for i, k in enumerate(keys)])
    return df.join(named, reduce(and_, [F.col(f"__w{i}").eqNullSafe(column(k)) for i, k in enumerate(keys)]), how)


def hash_classify(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], null_safe_keys: bool = True, multiset: bool = False) -> DataFrame:
    """As classify or pair_off; values are read only for keys that the hashes show to differ, if these are few. A matched row has no values then."""
    whole = pair_off if multiset else classify
    found = stored(hash_groups(a, b, keys, values) if multiset else hash_candidates(a, b, keys, values, null_safe_keys), "hash-candidates")
    wrong = found.where("status <> 'matched'")
    if multiset and not null_safe_keys:
        alone = reduce(or_, [column(k).isNull() for k in keys])
        wrong, found = found.where((F.col("status") != "matched") | alone), found.where(~alone)
    wrong = wrong.select(*[column(k) for k in keys]).distinct()
    n = wrong.limit(BROADCAST_ROWS + 1).count()
    if n > BROADCAST_ROWS:
        return whole(a, b, keys, values, null_safe_keys)
    empty = "struct<" + ",".join(f"`{c}`:{a.schema[c].dataType.simpleString()}" for c in values) + ">" if values else "struct<_:int>"
    matched = found.where("status = 'matched'")
    if multiset:  # as many rows as the key has, in blocks, so that no array is long
        block = 1000
        matched = matched.withColumn("__b", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / block).cast("int"))))
        matched = matched.withColumn("__i", F.explode(F.sequence(F.lit(1), F.least(F.lit(block), F.col("n") - F.col("__b") * block).cast("int"))))
    plain = matched.select(F.struct(*[column(k).alias(k) for k in keys]).alias("key"), "status", F.array().cast("array<string>").alias("mismatched_columns"), F.lit(None).cast(empty).alias("source_values"), F.lit(None).cast(empty).alias("target_values"))
    if not n:
        return plain
    wrong = F.broadcast(wrong)
    if not multiset:  # a repeated key may have pairs that match beside some that do not: all its pairs come from its rows
        plain = with_keys(plain, wrong.select(F.struct(*[column(k).alias(k) for k in keys]).alias("key")), ["key"], "left_anti")
    return plain.unionByName(whole(with_keys(a, wrong, keys), with_keys(b, wrong, keys), keys, values, null_safe_keys))


class TableDiff:
    """Compares source and target by key.

    duplicates: multiset pairs repeated keys off one to one, fanout pairs each with each as SQL does, error refuses
    them. null_keys: equal lets null keys match each other, sql never.
    """

    def __init__(self, source: DataFrame, target: DataFrame, keys, target_keys=None, *, duplicates: str = "multiset", null_keys: str = "equal", source_name: str = "source", target_name: str = "target", segment_key: str | None = None):
        self.source, self.target = source, target
        self.keys = [keys] if isinstance(keys, str) else list(keys or [])
        self.target_keys = self.keys if target_keys is None else [target_keys] if isinstance(target_keys, str) else list(target_keys)
        if duplicates not in DUPLICATES or null_keys not in ("equal", "sql"):
            raise ValueError(f"duplicates is one of {DUPLICATES}, null_keys is equal or sql")
        if not self.keys:
            raise ValueError("keys are missing")
        self.duplicates, self.null_safe = duplicates, null_keys == "equal"
        self.names, self.segment_key = (source_name, target_name), segment_key

    def compare(self, algorithm: Algorithm | str = Algorithm.AUTO, *, matched_rows: bool = True, **options) -> DiffRun:
        """AUTO joins, or cuts segments if there is a segment key. Without matched_rows (matched rows counted, not listed) it
        first estimates from a sketch of both sides how many rows differ, and takes the strategy that moves least."""
        began = time.time()
        algorithm = Algorithm(algorithm)
        estimating = algorithm is Algorithm.AUTO and not matched_rows and not self.segment_key
        if algorithm is Algorithm.AUTO:
            algorithm = Algorithm.BISECTION if self.segment_key else Algorithm.JOIN_DIFF
        run = DiffRun(algorithm, self.keys, *self.names, schema_differences=compare_schemas(self.source, self.target))
        try:
            a, b, keys, values = aligned(self.source, self.target, self.keys, self.target_keys)
            run.keys, run.common_columns = keys, keys + values
            multiset = self.duplicates == "multiset"
            if self.duplicates == "error":
                for name, df in zip(self.names, (a, b)):
                    if not df.groupBy(*[column(k) for k in keys]).count().where("count > 1").isEmpty():
                        raise ValueError(f"{name} has duplicate keys")
            told = None
            if estimating or algorithm is Algorithm.SKETCH_DIFF:
                algorithm, told = self._by_sketch(run, a, b, keys, values, multiset, estimating)
            if told:
                run.rows, run.metadata = told
            elif algorithm is Algorithm.BISECTION:
                from .bisect import bisect

                run.rows, run.metadata = bisect(a, b, keys, values, self.segment_key or keys[0], null_safe_keys=self.null_safe, multiset=multiset, **options)
                if resolve(self.segment_key or keys[0], self.source.columns) not in keys:
                    run.warnings.append(f"segment key {self.segment_key} is not a key: a row whose {self.segment_key} changes may be in another segment of the target")
            elif algorithm is Algorithm.HASH_DIFF:
                run.rows = hash_classify(a, b, keys, values, self.null_safe, multiset)
            else:
                run.rows = (pair_off if multiset else classify)(a, b, keys, values, self.null_safe)
        except ValueError as e:
            run.error = str(e)
        run.execution_time_seconds = time.time() - began
        return run

    def _by_sketch(self, run: DiffRun, a: DataFrame, b: DataFrame, keys: list[str], values: list[str], multiset: bool, free: bool) -> tuple[Algorithm, tuple[DataFrame, dict] | None]:
        """The strategy taken, and rows and counts if that is the sketch itself. free: any strategy may be taken."""
        from . import reconcile as R

        if self.duplicates == "fanout" and not free:
            raise ValueError("SKETCH_DIFF needs duplicates multiset or error: pairs of different rows of one key are lost where a key's rows are equal on both sides")
        x, y = (a, b) if self.null_safe else (R.named(a, keys), R.named(b, keys))
        found = R.difference(x, y, keys + values)
        run.metadata = {"estimated_differences": found.rows}
        run.algorithm = R.choose(found, self.duplicates != "fanout") if free else Algorithm.SKETCH_DIFF
        told = R.sketch_classify(a, b, keys, values, self.null_safe, multiset, found) if run.algorithm is Algorithm.SKETCH_DIFF else None
        if run.algorithm is Algorithm.SKETCH_DIFF and told is None:
            run.algorithm = Algorithm.HASH_DIFF
            run.warnings.append(f"about {found.rows} rows differ, more than a sketch tells: compared by hashes")
        return run.algorithm, told


def anti_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a that b does not have."""
    return a.select(*keys).alias("a").join(b.select(*keys).alias("b"), on_keys(keys), "left_anti")


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).alias("a").join(b.select(*keys).alias("b"), on_keys(keys), "left_semi").distinct()


def rows_with_keys(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df whose key is in wanted: one semi join, however many keys there are."""
    return df.alias("a").join(wanted.select(*keys).alias("b"), on_keys(keys), "left_semi")


def summary_row(rows: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    found = rows.agg(n("added").alias("added"), n("deleted").alias("deleted"), n("modified").alias("modified"), n("matched").alias("matched"))
    return found.withColumn("total_differences", F.col("added") + F.col("deleted") + F.col("modified"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))
