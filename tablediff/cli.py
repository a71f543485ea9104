"""Command line: compares two tables and prints, and if asked stores, the outcome. Exit code 0 for a match, 1 for differences, 2 for errors."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions.names import common_columns
from .history import RETENTION, History
from .operators.diff import DUPLICATES, TableDiff
from .operators.model import SUGGEST_SEGMENTS_ABOVE, Algorithm
from .operators.schema import primary_keys
from .render import SHOWN, render
from .sources.config import ENVIRONMENT, Config, from_environment, missing_variables
from .sources.registry import open_source


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tablediff", description=__doc__)
    for side in ("source", "target"):
        p.add_argument(f"--{side}", required=True, help="KIND:PLACE, as parquet:/data/a, csv:/data/b.csv, table:db.t or postgresql:schema.t (settings from the environment)")
        p.add_argument(f"--{side}-table", help="table within a folder of files")
    p.add_argument("--keys", help="key columns, separated by commas; else the source's primary key")
    p.add_argument("--target-keys", help="key columns of the target where they have other names")
    p.add_argument("--algorithm", default="AUTO", choices=[a.value for a in Algorithm])
    p.add_argument("--segment-key", help="compares segments in the order of this column")
    p.add_argument("--duplicates", default="multiset", choices=DUPLICATES)
    p.add_argument("--show", type=int, default=SHOWN, help="modified rows to print")
    p.add_argument("--save", metavar="FOLDER", help="stores the run in a history folder")
    p.add_argument("--save-values", action="store_true")
    p.add_argument("--keep", type=int, default=RETENTION, help="runs kept of each comparison")
    return p


def load(spark: SparkSession, text: str, table: str | None, prefix: str):
    kind, _, place = text.partition(":")
    if kind in ENVIRONMENT:
        if (gone := missing_variables(kind)) and not all(f"{prefix}{v}" in __import__("os").environ for v in gone):
            raise ValueError(f"environment variables are missing for {kind}: {', '.join(gone)}")
        return open_source(spark, from_environment(kind, prefix=prefix)).table(place)
    if kind == "table":
        return open_source(spark, Config("table")).table(place)
    return open_source(spark, Config(kind, path=place)).table(table)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tablediff").getOrCreate()
    try:
        a, b = load(spark, o.source, o.source_table, "SOURCE_"), load(spark, o.target, o.target_table, "TARGET_")
        keys = o.keys.split(",") if o.keys else primary_keys(a)
        if not keys:
            raise ValueError(f"no primary key is known; choose --keys among {[x for x, _ in common_columns(a.columns, b.columns)]}")
        diff = TableDiff(a, b, keys, o.target_keys.split(",") if o.target_keys else None, duplicates=o.duplicates, source_name=o.source, target_name=o.target, segment_key=o.segment_key)
        run = diff.compare(o.algorithm, matched_rows=False)
        print(render(run, o.show))
        if run.error:
            return 2
        if run.summary.source_rows > SUGGEST_SEGMENTS_ABOVE and run.algorithm not in (Algorithm.BISECTION, Algorithm.SKETCH_DIFF):
            print(f"hint: above {SUGGEST_SEGMENTS_ABOVE:,} rows with few differences, --algorithm BISECTION moves less data")
        if o.save:
            history = History(spark, o.save)
            job = history.job(o.source, o.target, run.keys, keep=o.keep, save_original_values=o.save_values)
            print(f"saved as {history.save(job, run, o.save_values)}; removed {history.delete_old_runs(job, o.keep)} old runs")
        return 0 if run.match else 1
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
