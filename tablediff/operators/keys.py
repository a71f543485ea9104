"""Key discovery: the minimal sets of columns that tell all rows of a table apart.

Level by level: a set is looked at only if none of its subsets is a key, and if the values of its columns can make as
many combinations as there are rows. One aggregation a level sketches the distinct combinations of all sets that are left; those
far under the rows are dropped, the others are proven exactly by grouping, and the proof ends at the first repeated one.

The sketch only ever drops a set: its relative error is RSD, and a set is dropped at MARGIN errors under the rows, so a key is lost
with a chance of about one in a thousand million. No set that is not a key is ever reported.

Cases: nulls count as one value, NaN as one, as in GROUP BY. An empty table and a table of one row have every single column as a key
(no column is needed, but a set has at least one). Repeated rows: no key. Maps and variants are compared in normal form.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import normal_form
from ..functions.names import column, resolve

#: A sketch of 2 ** SKETCH_BITS places (16 kB at most) and its relative error; at most SETS_IN_ONE_PASS of them in one task.
SKETCH_BITS, RSD, MARGIN, SETS_IN_ONE_PASS = 14, 0.0082, 6, 200


def _proven(values: DataFrame, group: tuple[str, ...]) -> bool:
    """Whether no two rows agree on all columns of the group."""
    return values.groupBy(*[column(c) for c in group]).count().where("count > 1").isEmpty()


def _sketched(values: DataFrame, groups: list[tuple[str, ...]]) -> list[int]:
    """Estimates of the distinct combinations of each group, in one pass for every SETS_IN_ONE_PASS groups."""
    out: list[int] = []
    for low in range(0, len(groups), SETS_IN_ONE_PASS):
        # sketches of binary state: approx_count_distinct would make each of its words a column of the aggregate
        part = groups[low : low + SETS_IN_ONE_PASS]
        # a hash of nulls skips them, so a mark of what is null goes in as well
        parts = [F.xxhash64(*[column(c) for c in g], *[column(c).isNull() for c in g]) for g in part]
        out += values.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(p, F.lit(SKETCH_BITS))).alias(f"n{i}") for i, p in enumerate(parts)]).first()
    return out


def find_keys(df: DataFrame, max_columns: int = 3, columns: list[str] | None = None) -> list[tuple[str, ...]]:
    """Minimal keys of at most max_columns columns, the small ones first, columns in the table's order."""
    if max_columns < 1:
        raise ValueError("max_columns must be at least 1")
    kinds = {f.name: f.dataType for f in df.schema}
    named = df.columns if columns is None else [c for c in df.columns if c in {resolve(c, df.columns) for c in columns}]
    values = df.select(*[normal_form(column(c), kinds[c]).alias(c) for c in named])
    rows = values.count()
    # an upper bound of each column's values that holds but for a chance of one in a thousand million
    most = [n * (1 + MARGIN * RSD) + 1 for n in _sketched(values, [(c,) for c in named])]
    at_most = dict(zip(named, most))
    found: list[tuple[str, ...]] = []
    for size in range(1, min(max_columns, len(named)) + 1):
        groups = []
        for group in combinations(named, size):
            ways = 1.0
            for c in group:
                ways *= at_most[c]
            if ways >= rows and not any(set(k) <= set(group) for k in found):
                groups.append(group)
        estimates = _sketched(values, groups)
        likely = [g for g, n in zip(groups, estimates) if n >= rows * (1 - MARGIN * RSD) - 1]
        found += [g for g in likely if _proven(values, g)]
    return found
