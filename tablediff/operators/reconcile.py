"""How many rows differ, and which, from a sketch of both tables: no rows are shuffled.

A row is a 60-bit hash of its text (id) and a check made from that. Rows of the source count 1, rows of the target -1, so equal rows
cancel in any sum. A sketch has PARTS parts of cells; each row is added to one cell of each part. A cell that only one distinct row
is left in tells this row, which is then taken out of its other cells, until all are empty: the differing rows are told. Sums are
exact decimals, so a row that stands several times more on one side is told with that number.

Strata: rows are dealt to strata by the zeros at the end of their check, half to the first, a quarter to the next. Strata that can
be emptied are counted; the first that cannot gives the scale. One aggregation over both tables makes STRATA * PARTS * CELLS cells
at most, combined before the shuffle. If all strata are emptied the differing rows are known outright, else a second sketch of the
estimated size tells them, up to DECODED rows. Rows are then found by their ids, and their keys' rows are compared as by any strategy.

Empty tables, nulls, repeated rows and very long texts need no care of their own: a null is a text of its own in the row hash. Two
different rows whose ids collide cancel (as likely as for the other 60-bit hashes: about rows times differences in 2^60).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from hashlib import md5
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import row_text, short_hash
from ..functions.names import column
from ..scratch import BROADCAST_ROWS, stored
from .diff import classify, pair_off, with_keys
from .model import Algorithm

PARTS, CELLS, STRATA, SHIFT, BITS = 3, 80, 32, 20, 60

#: Rows that a second sketch is made for at most: its cells, PARTS for each row, come to the driver (about 100 bytes each).
DECODED = 50_000


@dataclass(frozen=True)
class Difference:
    """rows: estimated number of distinct rows that one side has more of; ids: these, with their surplus in the source, if the sketch told them."""

    rows: int
    source_rows: int
    target_rows: int
    ids: dict[int, int] | None


def sketch(a: DataFrame, b: DataFrame, columns: list[str], cells: int = CELLS, strata: int = STRATA) -> DataFrame:
    """stratum, part, cell, surplus, id_sum, check_sum, source_rows, target_rows: a row for each cell that any row falls in."""
    text = row_text(columns, a.schema)
    side = lambda df, sign: df.select(short_hash(text).alias("id"), F.lit(sign).alias("sign"))
    rows = side(a, 1).unionByName(side(b, -1)).withColumn("check", short_hash(F.col("id").cast("string")))
    zeros = F.bit_count(F.col("check").bitwiseAND(-F.col("check")) - 1)
    places = F.array(*[F.struct(F.lit(i).alias("part"), (F.shiftright("id", SHIFT * i) % cells).alias("cell")) for i in range(PARTS)])
    spread = rows.select("id", "check", "sign", F.least(zeros, F.lit(strata - 1)).alias("stratum"), F.inline(places))
    total = lambda c: F.sum((F.col("sign") * F.col(c)).cast("decimal(38,0)"))
    of = lambda sign: F.count(F.when(F.col("sign") == sign, 1))
    return spread.groupBy("stratum", "part", "cell").agg(F.sum("sign").alias("surplus"), total("id").alias("id_sum"), total("check").alias("check_sum"), of(1).alias("source_rows"), of(-1).alias("target_rows"))


def check_of(row: int) -> int:
    return int(md5(str(row).encode()).hexdigest()[: BITS // 4], 16)


def peel(held: dict[tuple[int, int], list[int]], cells: int) -> dict[int, int] | None:
    """The rows left in one stratum's cells with their surplus, or None if the cells cannot be emptied. held is used up."""
    found: dict[int, int] = {}
    waiting = list(held)
    while waiting:
        at = waiting.pop()
        surplus, ids, checks = held[at]
        if not surplus or ids % surplus:
            continue
        row = ids // surplus
        if not 0 <= row < 2**BITS or (row >> SHIFT * at[0]) % cells != at[1] or checks != surplus * check_of(row):
            continue
        found[row] = found.get(row, 0) + surplus
        for i in range(PARTS):
            place = (i, (row >> SHIFT * i) % cells)
            cell = held.setdefault(place, [0, 0, 0])
            cell[0], cell[1], cell[2] = cell[0] - surplus, cell[1] - ids, cell[2] - checks
            waiting.append(place)
    return None if any(any(cell) for cell in held.values()) else {row: n for row, n in found.items() if n}


def difference(a: DataFrame, b: DataFrame, columns: list[str]) -> Difference:
    """Estimates how many rows differ; a few are told outright. One aggregation over both tables."""
    held: dict[int, dict] = {}
    source = target = 0
    for r in sketch(a, b, columns).collect():  # STRATA * PARTS * CELLS rows at most
        held.setdefault(r.stratum, {})[r.part, r.cell] = [r.surplus, int(r.id_sum), int(r.check_sum)]
        source, target = source + r.source_rows * (r.part == 0), target + r.target_rows * (r.part == 0)
    ids: dict[int, int] = {}
    for stratum in range(STRATA - 1, -1, -1):
        found = peel(held.get(stratum, {}), CELLS)
        if found is None:
            return Difference(max(len(ids), 1) << (stratum + 1), source, target, None)
        ids |= found
    return Difference(len(ids), source, target, ids)


def decode(a: DataFrame, b: DataFrame, columns: list[str], expected: int) -> dict[int, int] | None:
    """The differing rows from one sketch without strata, with PARTS cells for each expected row; None if they are too many for it."""
    cells = max(1000, expected)  # in few cells two rows may share all of theirs
    left = sketch(a, b, columns, cells, 1).where("surplus <> 0 or id_sum <> 0 or check_sum <> 0")
    return peel({(r.part, r.cell): [r.surplus, int(r.id_sum), int(r.check_sum)] for r in left.collect()}, cells)  # PARTS * cells rows at most


def choose(found: Difference, telling: bool = True) -> Algorithm:
    """The strategy that moves least: a sketch for what it can tell, hashes where the differing keys can be broadcast, else the join. telling is false where equal rows may still make differences (repeated keys that fan out)."""
    if telling and (found.ids is not None or found.rows <= DECODED):
        return Algorithm.SKETCH_DIFF
    return Algorithm.HASH_DIFF if found.rows <= BROADCAST_ROWS else Algorithm.JOIN_DIFF


def named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(reduce(and_, [column(k).isNotNull() for k in keys]))


def sketch_classify(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], null_safe_keys: bool = True, multiset: bool = False, found: Difference | None = None) -> tuple[DataFrame, dict] | None:
    """Rows of all keys that have a differing row, compared as classify or pair_off do, and counts; None if the sketch does not tell them.

    Rows of other keys are equal on both sides: they are counted in rows_in_equal_segments (once each, repeated keys too), not listed.
    With null_safe_keys false, rows with a null key are told besides.
    """
    whole: Callable = pair_off if multiset else classify
    x, y = (a, b) if null_safe_keys else (named(a, keys), named(b, keys))
    columns = keys + values
    found = found or difference(x, y, columns)
    ids = found.ids
    if ids is None and found.rows <= DECODED:
        ids = decode(x, y, columns, 2 * found.rows)
    if ids is None:
        return None
    meta = {"estimated_differences": found.rows, "differing_rows": len(ids), "second_sketch": found.ids is None}
    if ids:
        wanted = F.broadcast(a.sparkSession.createDataFrame(pa.table({"__id": pa.array(list(ids), pa.int64())})))  # DECODED times a few at most
        text = row_text(columns, a.schema)
        at = lambda df: df.withColumn("__id", short_hash(text)).join(wanted, "__id", "left_semi").select(*[column(k) for k in keys])
        told = stored(at(x).unionByName(at(y)).distinct(), "sketch-keys")
        near = F.broadcast(told)  # no more keys than ids
        mine, theirs = with_keys(x, near, keys), with_keys(y, near, keys)
        rows, here = whole(mine, theirs, keys, values, null_safe_keys), mine.count()
    else:
        rows, here = whole(x.limit(0), y.limit(0), keys, values, null_safe_keys), 0
    if not null_safe_keys:
        alone = lambda df: df.where(~reduce(and_, [column(k).isNotNull() for k in keys]))
        rows = rows.unionByName(whole(alone(a), alone(b), keys, values, False))
    return rows, meta | {"rows_in_equal_segments": found.source_rows - here}
