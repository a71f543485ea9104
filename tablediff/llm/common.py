"""Shared pieces of the training-data operators: tables, the shared scratch folder, folds, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) modulo FOLDS equals HELD_FOLD are never learned from.
FOLDS, HELD_FOLD = 4, 2

#: A side with at most this many narrow rows (ids or digests, under 64 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


#: Rows, and bytes, that executors and their Python workers exchange at once; with the defaults of 10,000 texts and no bound they would hold a tenth of a GB each.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes of an Arrow batch to BATCH_ROWS and BATCH_BYTES; smaller settings stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        held = str(spark.conf.get(key)).lower().removesuffix("b")
        if not held.lstrip("-").isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, most)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="tablediff-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, rows_a_file: int = 0) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so that what follows neither recomputes it nor depends on one executor.

    Rows of many MB want rows_a_file: Parquet's writer looks at the size of what it holds after 100 rows, and its reader takes 4,096 rows of a file at once.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it is proven to have no more than BROADCAST_ROWS rows, df itself otherwise."""
    if rows is None:
        rows = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows of the held-out fold; a null id is never held out."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_FOLD, F.lit(False))


def ship(spark: SparkSession, thing):
    """A broadcast of thing with the code of its classes, so executors need no installation; taken up by unship."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def unship(shared):
    return cloudpickle.loads(shared.value)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow or mapInPandas; when a task ends its worker, which stays for later tasks, gives back the memory that it does not use."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only some C libraries have it
        pass


def settle(spark: SparkSession) -> None:
    """Has the driver's JVM and each executor's collect its garbage once, one small task for each executor, and gives back what the driver's Python does not use.

    A heap that has grown in one stage of a long job is else kept, mostly empty, until it is full, with the native buffers that
    its garbage holds; the Python workers of the next stage need that memory.
    """
    executors = max(spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1, 1)
    spark.range(0, executors, 1, executors).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()
