"""History of comparisons as Parquet tables: what was compared, when, with which result, and how many runs are kept.

Parquet has no transactions. A run's tables are written first and its entry in diff_run last, so a run that was
broken off is never listed. Run tables are partitioned by job_id and run_id; retention removes those folders.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.hashing import key_hash_column
from .operators.model import MAX_DETAIL_ROWS, DiffRun

# Ids and names of the default project and user.
DEFAULT_PROJECT = ("00000000-0000-0000-0000-000000000001", "default")
DEFAULT_USER = ("00000000-0000-0000-0000-000000000002", "cli")
RETENTION = 10

TABLES = {
    "project": "project_id string, name string, description string",
    "user": "user_id string, email string, name string, local_cli boolean",
    "project_source": "source_id string, project_id string, source_type string, source_name string, host string, port int, db_name string, user_id string",
    "diff_job": "job_id string, project_id string, source_a_id string, source_a_asset string, source_b_id string, source_b_asset string, key_columns string, snapshot_retention_count int, save_original_values boolean",
    "diff_run": "run_id string, job_id string, run_at timestamp, status string, algorithm string, execution_time_seconds double, match boolean, error string, metadata string",
    "diff_run_detail": "run_id string, job_id string, source_a_asset string, source_a_row_count long, source_b_asset string, source_b_row_count long, common_columns string, schema_differences string, columns_not_matched string",
    "diff_result": "run_id string, job_id string, added_count long, deleted_count long, modified_count long, matched_count long, diffed_at timestamp",
    "diff_row": "run_id string, job_id string, key_hash string, key_values string, status string, mismatched_columns string, source_values string, target_values string",
}
OF_RUN = ("diff_row", "diff_run_detail", "diff_result", "diff_run")


def runs_newest_first(runs: DataFrame, job_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Runs of each job, newest first; with limit, so many of each job."""
    if job_id is not None:
        runs = runs.where(F.col("job_id") == job_id)
    if limit is not None:
        newest = Window.partitionBy("job_id").orderBy(F.desc("run_at"), F.desc("run_id"))
        runs = runs.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= limit).drop("__k")
    return runs.orderBy("job_id", F.desc("run_at"), F.desc("run_id"))


def retention_victims(runs: DataFrame, keep: int) -> DataFrame:
    newest = Window.partitionBy("job_id").orderBy(F.desc("run_at"), F.desc("run_id"))
    return runs.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") > keep).drop("__k")


def columns_not_matched(schema_differences: dict) -> dict:
    return {"source_only": schema_differences.get("columns_only_in_a", []), "target_only": schema_differences.get("columns_only_in_b", [])}


class History:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.setup()

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def setup(self) -> None:
        """Creates what is missing; may be called again at any time."""
        for name in TABLES:
            fs, p = self._file(f"{self.path}/{name}")
            fs.mkdirs(p)
        self._ensure("project", ["project_id"], [(*DEFAULT_PROJECT, None)])
        self._ensure("user", ["user_id"], [(DEFAULT_USER[0], None, DEFAULT_USER[1], True)])

    def read(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(TABLES[name]).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")
        if name in OF_RUN[:-1]:  # of a run that was broken off there are rows but no entry
            rows = rows.join(self.read("diff_run").select("run_id"), "run_id", "left_semi")
        return rows

    def _ensure(self, name: str, unique: list[str], rows: list[tuple]) -> None:
        new = self.spark.createDataFrame(rows, TABLES[name]).join(self.read(name).select(*unique), unique, "left_anti")
        if not new.isEmpty():
            new.coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def source(self, source_type: str, source_name: str, host: str | None = None, port: int | None = None, db_name: str | None = None) -> str:
        """The id of a source, the same for the same project, type and name. Credentials are never stored."""
        source_id = str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([DEFAULT_PROJECT[0], source_type, source_name])))
        self._ensure("project_source", ["source_id"], [(source_id, DEFAULT_PROJECT[0], source_type, source_name, host, port, db_name, DEFAULT_USER[0])])
        return source_id

    def job(self, source_asset: str, target_asset: str, keys: list[str], source_id: str | None = None, target_id: str | None = None, keep: int = RETENTION, save_original_values: bool = False) -> str:
        source_id, target_id = source_id or self.source("spark", "session"), target_id or self.source("spark", "session")
        named = json.dumps(sorted(keys))
        job_id = str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([source_id, source_asset, target_id, target_asset, named])))
        self._ensure("diff_job", ["job_id"], [(job_id, DEFAULT_PROJECT[0], source_id, source_asset, target_id, target_asset, named, keep, save_original_values)])
        return job_id

    def save(self, job_id: str, run: DiffRun, save_original_values: bool | None = None, run_at: datetime | None = None) -> str:
        """Stores a run with its first differences; values only if asked for here or by the job."""
        run_id, at, s = str(uuid.uuid4()), run_at or datetime.now(timezone.utc), run.summary
        if save_original_values is None:
            found = self.read("diff_job").where(F.col("job_id") == job_id).select("save_original_values").first()
            save_original_values = bool(found and found[0])
        if run.rows is not None:
            text = lambda c: F.when(F.lit(save_original_values), F.to_json(c))
            wrong = F.when(F.col("status") == "modified", F.to_json("mismatched_columns"))
            rows = run.detail(MAX_DETAIL_ROWS).select("key", "key.*", "status", "mismatched_columns", "source_values", "target_values")
            rows = rows.select(F.lit(run_id).alias("run_id"), F.lit(job_id).alias("job_id"), key_hash_column(run.keys).alias("key_hash"), F.to_json("key", {"ignoreNullFields": "false"}).alias("key_values"), "status", wrong.alias("mismatched_columns"), text("source_values").alias("source_values"), text("target_values").alias("target_values"))
            self._write("diff_row", job_id, run_id, rows)
        differences = json.dumps(run.schema_differences, default=str)
        self._write("diff_run_detail", job_id, run_id, [(run_id, job_id, run.source_asset, s and s.source_rows, run.target_asset, s and s.target_rows, json.dumps(run.common_columns), differences, json.dumps(columns_not_matched(run.schema_differences)))])
        if s:
            self._write("diff_result", job_id, run_id, [(run_id, job_id, s.added, s.deleted, s.modified, s.matched, at)])
        self._write("diff_run", job_id, run_id, [(run_id, job_id, at, "failed" if run.error else "success", run.algorithm.value, run.execution_time_seconds, run.match if s else None, run.error, json.dumps(run.metadata))])
        return run_id

    def _write(self, name: str, job_id: str, run_id: str, rows) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, TABLES[name])
        df.coalesce(1).write.parquet(f"{self.path}/{name}/{job_id}/{run_id}")

    def list_runs(self, job_id: str | None = None, limit: int | None = None) -> DataFrame:
        return runs_newest_first(self.read("diff_run"), job_id, limit)

    def delete_old_runs(self, job_id: str, keep: int | None = None) -> int:
        """Removes all but the newest runs of a job with their rows; the entry goes first, so no run is listed without its rows."""
        if keep is None:
            found = self.read("diff_job").where(F.col("job_id") == job_id).select("snapshot_retention_count").first()
            keep = found[0] if found else RETENTION
        gone = [r.run_id for r in retention_victims(self.read("diff_run").where(F.col("job_id") == job_id), keep).select("run_id").collect()]
        for run_id in gone:
            for name in reversed(OF_RUN):
                fs, p = self._file(f"{self.path}/{name}/{job_id}/{run_id}")
                fs.delete(p, True)
        return len(gone)
