"""Segment comparison: hash segments of both sides, then classify only rows of segments that differ.

ntile: equal-sized segments in key order. The places are counted without gathering all rows in one task: keys and row hashes are dealt by
ranges of the key, written once, counted for each range, and offset by the ranges before. Rows of all keys that
stand in a differing segment of either side are classified together, so a row that moves to the next segment is not reported.

range: the same bounds of the segment key for both sides, taken from the source's quantiles; a segment that differs and
holds more than threshold rows is cut again, down to max_depth. The finest level that threshold asks for, MOST_CELLS cells at most, is
counted and summed at once, in one pass over each side; coarser levels add up its sums, and then only rows of segments that
differ are read. Keys that are no numbers are cut by a number that follows their order (dates, times, texts by the bytes after what all have in common) or by a hash.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import row_text, short_hash
from ..functions.names import column, resolve
from ..scratch import sized, stored
from .diff import classify, pair_off, with_keys
from .model import SEGMENT_THRESHOLD, SEGMENTS


def tile(place: Column, total: Column, n: int) -> Column:
    """The NTILE number of a 1-based place among total rows."""
    q, r = F.floor(total / n), total % n
    return F.when(q == 0, place).when(place <= r * (q + 1), F.ceil(place / (q + 1))).otherwise(r + F.ceil((place - r * (q + 1)) / F.greatest(q, F.lit(1)))).cast("int")


def with_segments(df: DataFrame, order: list[str], n: int = SEGMENTS, partitions: int | None = None, by: str | None = None) -> DataFrame:
    """df with segment, as NTILE(n) over order gives it, for each value of by if that is named. It is written once in ranges of order, because ranges may be drawn anew when they are computed again; give it narrow rows."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = [by] if by else []
    dealt = stored(df.repartitionByRange(parts, *[column(c).asc_nulls_first() for c in own + order]).withColumn("__part", F.spark_partition_id()), "segments")
    sizes = dealt.groupBy("__part", *own).agg(F.count("*").alias("__rows"))  # a row or two for each partition
    before = Window.partitionBy(*own).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", *own, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(Window.partitionBy(*own)).alias("__total"))
    within = F.row_number().over(Window.partitionBy("__part", *own).orderBy(*[column(c).asc_nulls_first() for c in order]))
    placed = dealt.withColumn("__within", within).join(F.broadcast(offsets), ["__part", *own])
    return placed.withColumn("segment", tile(F.col("__before") + F.col("__within"), F.col("__total"), n)).drop("__part", "__within", "__before", "__total")


def _sums(h: Column) -> list[Column]:
    return [F.count("*").alias("row_count"), F.bit_xor(h).alias("seg_hash"), F.sum(h.cast("decimal(38,0)")).alias("seg_sum")]


def segment_sums(df: DataFrame, text: Column) -> DataFrame:
    """segment, row_count, seg_hash, seg_sum: a row for each segment. The sum is a second check beside the exclusive or."""
    return df.groupBy("segment").agg(*_sums(short_hash(text)))


def _compared(a: DataFrame, b: DataFrame, threshold: int) -> DataFrame:
    """All segments, their rows on both sides, whether they differ (one side lacks them or their sums differ), and whether either side holds more than threshold rows."""
    joined = a.alias("a").join(b.alias("b"), "segment", "full_outer")
    wrong = ~F.col("a.row_count").eqNullSafe(F.col("b.row_count")) | ~F.col("a.seg_hash").eqNullSafe(F.col("b.seg_hash"))
    if "seg_sum" in a.columns:
        wrong = wrong | ~F.col("a.seg_sum").eqNullSafe(F.col("b.seg_sum"))
    rows = F.greatest(F.coalesce("a.row_count", F.lit(0)), F.coalesce("b.row_count", F.lit(0)))
    return joined.select("segment", F.col("a.row_count").alias("rows_a"), F.col("b.row_count").alias("rows_b"), (rows > threshold).alias("over_threshold"), wrong.alias("wrong"))


def differing(a: DataFrame, b: DataFrame, threshold: int = SEGMENT_THRESHOLD) -> DataFrame:
    """Segments that one side lacks or whose sums differ, and whether either side holds more than threshold rows."""
    return _compared(a, b, threshold).where("wrong").drop("wrong")


def bisect(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], segment_key: str, *, mode: str = "ntile", segments: int = SEGMENTS, threshold: int = SEGMENT_THRESHOLD, max_depth: int = 4, null_safe_keys: bool = True, multiset: bool = False) -> tuple[DataFrame, dict]:
    segment_key = resolve(segment_key, a.columns)
    whole = pair_off if multiset else classify
    if not null_safe_keys:
        # rows with a null key match none: they are told besides, and are in no segment
        named = reduce(and_, [column(k).isNotNull() for k in keys])
        options = {"mode": mode, "segments": segments, "threshold": threshold, "max_depth": max_depth, "multiset": multiset}
        rows, meta = bisect(a.where(named), b.where(named), keys, values, segment_key, **options)
        return rows.unionByName(whole(a.where(~named), b.where(~named), keys, values, False)), meta
    text = row_text(keys + values, a.schema)
    if mode == "ntile":
        order = list(dict.fromkeys([segment_key, *keys, "__h"]))
        narrow = lambda df, source: df.select(*[column(c) for c in order[:-1]], short_hash(text).alias("__h"), F.lit(source).alias("__a"))
        placed = with_segments(narrow(a, True).unionByName(narrow(b, False)), order, segments, by="__a")
        sums = lambda source: placed.where(F.col("__a") == source).groupBy("segment").agg(*_sums(F.col("__h")))
        found = _compared(sums(True), sums(False), threshold).collect()  # segments rows at most
        wrong = [r.segment for r in found if r.wrong]
        meta = {"segment_count": segments, "depth_reached": int(bool(wrong)), "segments_compared": segments, "segments_differing": len(wrong)}
        total = sum(r.rows_a or 0 for r in found)
        if not wrong:
            return whole(a.limit(0), b.limit(0), keys, values, null_safe_keys), meta | {"rows_in_equal_segments": total}
        wanted = stored(placed.where(F.col("segment").isin(wrong)).select(*[column(k) for k in keys]).distinct(), "segment-keys")
        wanted = sized(wanted)
        here = with_keys(placed.where("__a"), wanted, keys).count()  # rows of a key may stand in equal segments too
        return whole(with_keys(a, wanted, keys), with_keys(b, wanted, keys), keys, values, null_safe_keys), meta | {"rows_in_equal_segments": total - here}
    if mode != "range":
        raise ValueError("mode is ntile or range")
    return _ranges(a, b, keys, values, segment_key, text, segments, threshold, max_depth, whole, null_safe_keys)


def _number(df: DataFrame, other: DataFrame, key: str) -> Column:
    """A number for the segment key, the same for equal keys of both sides, in their order if it has one."""
    c, kind = column(key), df.schema[key].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.StringType):
        ends = [x for d in (df, other) for x in d.agg(F.min(column(key)), F.max(column(key))).first() if x is not None]
        raw = [x.encode() for x in ends] or [b""]
        common = next((i for i, two in enumerate(zip(min(raw), max(raw))) if two[0] != two[1]), min(map(len, raw)))
        tail = F.rpad(F.hex(F.substring(c.cast("binary"), common + 1, 7)), 14, "0")
        return F.conv(tail, 16, 10).cast("long")
    return F.when(c.isNotNull(), F.xxhash64(c))


#: Cells of the finest level at most: what goes through the driver, however large the tables are.
MOST_CELLS = 1 << 16


def _in_cells(df: DataFrame, number: Column, bounds: list[float]) -> DataFrame:
    """df with cell: how many of bounds the number has reached; for a null (or NaN) one more than there are bounds."""
    numbered = df.withColumn("__p", F.coalesce(number.cast("double"), F.lit(float("nan"))))
    if not bounds:
        return numbered.withColumn("cell", F.isnan("__p").cast("long")).drop("__p")
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__p", outputCol="__cell", handleInvalid="keep")
    return cut.transform(numbered).withColumn("cell", F.col("__cell").cast("long")).drop("__p", "__cell")


def _ranges(a, b, keys, values, key, text, segments, threshold, max_depth, whole, null_safe_keys) -> tuple[DataFrame, dict]:
    if not 1 < segments < 64:
        raise ValueError("segments is at least 2 and under 64")
    number, n, deepest = _number(a, b, key), a.count(), 1
    while deepest < max_depth and segments**deepest * threshold < 2 * n and segments ** (deepest + 1) <= MOST_CELLS:
        deepest += 1
    grid = segments**deepest
    shares = [i / grid for i in range(1, grid)]
    bounds = np.array(a.agg(F.percentile_approx(number.cast("double"), shares, max(2 * grid, 10_000)).alias("q")).first().q or [], float)
    own = np.unique(bounds[np.isfinite(bounds)])
    # cells before each place of the grid; equal bounds have none between them
    cuts = np.concatenate([[0], np.searchsorted(own, bounds, "right") if len(bounds) else np.ones(grid - 1, int), [len(own) + 1]])
    sums = lambda df: _in_cells(df.select(number.alias("__n"), short_hash(text).alias("__h")), F.col("__n"), own.tolist()).groupBy(F.col("cell").alias("segment")).agg(*_sums(F.col("__h")))
    rows, wrong, null = np.zeros(len(own) + 2, np.int64), np.zeros(len(own) + 2, bool), len(own) + 1
    for r in _compared(sums(a), sums(b), threshold).collect():  # a row for each cell
        rows[r.segment], wrong[r.segment] = r.rows_a or 0, r.wrong
    leaves = [(null, null + 1)] if wrong[null] else []
    level, count, compared, depth = [(0, grid)], 1, 1, 0  # nulls are a segment; segments go by places of the grid
    for at in range(1, deepest + 1):
        step, pieces = grid // segments**at, []
        for low, high in level:
            places = range(low, high + 1, step)
            pieces += [(x, y) for x, y in zip(places, places[1:]) if cuts[y] > cuts[x]]
        count, compared = count + len(pieces) - (len(level) if at > 1 else 0), compared + len(pieces)
        found = [(x, y) for x, y in pieces if wrong[cuts[x] : cuts[y]].any()]
        depth += bool(found) or at == 1 and bool(leaves)
        # a segment with few rows of the source, or of one cell, is not cut again
        level = [(x, y) for x, y in found if at < deepest and rows[cuts[x] : cuts[y]].sum() > threshold and cuts[y] - cuts[x] > 1]
        again = set(level)
        leaves += [(int(cuts[x]), int(cuts[y])) for x, y in found if (x, y) not in again]
        if not level:
            break
    taken = np.zeros(len(rows), bool)
    for low, high in leaves:
        taken[low:high] = True
    take = lambda df: _of_cells(df, number, own.tolist(), taken)
    meta = {"segment_count": count, "depth_reached": depth, "segments_compared": compared, "segments_differing": len(leaves), "rows_in_equal_segments": n - int(rows[taken].sum())}
    return whole(take(a), take(b), keys, values, null_safe_keys), meta


def _of_cells(df: DataFrame, number: Column, bounds: list[float], taken: np.ndarray) -> DataFrame:
    """The rows of df in cells that are taken."""
    if not taken.any():
        return df.limit(0)
    if taken[:-1].all():  # but for nulls nothing is left out
        return df if taken[-1] else df.where(number.isNotNull() & ~F.isnan(number.cast("double")))
    wanted = F.broadcast(df.sparkSession.createDataFrame(pa.table({"cell": pa.array(np.flatnonzero(taken), pa.int64())})))
    return _in_cells(df, number, bounds).join(wanted, "cell", "left_semi").select(*[column(c) for c in df.columns])
