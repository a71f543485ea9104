"""Exact deduplication by a stream with keyed state on disk.

Digests of the documents (never their texts) are staged as a table in the shared folder, and a stream
takes them up. Its state, in RocksDB without expiry, holds for each digest the stable identifier of the row
that stays, its content locator (the number of the call and the row's place in it) and the number of rows seen; copies are
combined before they are dealt out, so a digest with a third of all rows costs no more than any other. Where a digest was
hit more than once the full normalised bytes of its rows are compared; if they differ the rows are regrouped by their bytes.

A call that was broken off, at whatever point, may be run again with the same rows: its staged rows are named by the number of the
call, and a mark is left when a call has ended. If the last call left none and its rows are those of this one, this is that call; if its rows
were not all staged they are staged anew, which the stream has not seen yet.

A later call with the same state folder goes on from the state that is there, and gives all rows seen so far. For that the folder
also holds the content: under each digest the least and the greatest of its texts, which are one unless digests clash.

Cases: null text counts as empty, empty texts are equal to each other. Ties in length go to the smallest
doc_id; null ids come last and never win over a real id. Of repeated rows with one id the first by
locator is kept, in one call or over several. Extra columns are ignored by find_copies and carried through by drop_copies. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, read_table, scratch_path, sized_broadcast, whole_text

#: The characters of [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false", "spark.sql.streaming.stateStore.unloadOnCommit": "true"}


def normal(text: str = "text") -> Column:
    return F.translate(whole_text(text), SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rank() -> Column:
    """Orders as: most code points, then a real id, then the smallest id, then the first call and place; the maximum stays."""
    return F.struct("points", F.col("doc_id").isNotNull().alias("real"), (-F.coalesce("doc_id", F.lit(0))).alias("less"), (-F.col("call")).alias("call"), (-F.col("locator")).alias("before"))


def _kept(rank: str) -> list[Column]:
    """The id and the locator of the row that stays."""
    return [F.when(F.col(f"{rank}.real"), -F.col(f"{rank}.less")).alias("keep_id"), (-F.col(f"{rank}.call")).alias("keep_call"), (-F.col(f"{rank}.before")).alias("keep_at")]


def keyed_state(spark: SparkSession, staged: str, schema, state: str) -> DataFrame:
    """Runs the stream over what is new in staged and returns its state: digest, keep_id, keep_call, keep_at, group_size."""
    was = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    try:
        for k, v in STREAM_CONF.items():
            spark.conf.set(k, v)
        groups = spark.readStream.schema(schema).parquet(staged).groupBy("digest").agg(F.max(_rank()).alias("kept"), F.count("*").alias("group_size"))
        stream = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        stream.awaitTermination()
        found = spark.read.format("statestore").option("path", state).load()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # the state's value holds the aggregates in the order in which the query lists them
    kept, size = (f"value.`{c}`" for c in found.schema["value"].dataType.names)
    return found.select(F.col("key.digest").alias("digest"), *_kept(kept), F.col(size).alias("group_size"))


def _extremes(texts: DataFrame) -> DataFrame:
    """digest, least, most: of (digest, least, most). Both are combined before the shuffle, so copies meet as one row for each task."""
    return texts.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def _texts(docs: DataFrame, digest) -> DataFrame:
    own = docs.select(normal().alias("bytes"))
    return own.select(digest(F.col("bytes")).alias("digest"), F.col("bytes").alias("least"), F.col("bytes").alias("most"))


def _calls(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that earlier calls have written, if there is one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def _remember(docs: DataFrame, path: str, call: int, digest) -> DataFrame:
    """digest, least, most of all calls; those of this call that are new are written first, so a call that is run again finds them."""
    earlier = _calls(docs.sparkSession, path)
    own = _extremes(_texts(docs, digest))
    if earlier is not None:
        own = own.join(_extremes(earlier).toDF("digest", "first", "last"), "digest", "left").where("first is null or least < first or most > last").select("digest", "least", "most")
    own.write.mode("overwrite").parquet(f"{path}/call={call}")
    return _extremes(docs.sparkSession.read.parquet(path).select("digest", "least", "most"))


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _staged_calls(spark: SparkSession, staged: str) -> list[int]:
    if not _there(spark, staged):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(staged)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(n.removeprefix("call=")) for n in names if n.startswith("call="))


def _open_call(base: str, narrow: DataFrame) -> tuple[int, bool]:
    """The number of this call, and whether its rows are yet to be staged."""
    spark, staged = narrow.sparkSession, f"{base}/staged"
    calls = _staged_calls(spark, staged)
    if not calls or _there(spark, f"{base}/ended/call={calls[-1]}"):
        return (calls[-1] + 1 if calls else 0), True
    last = f"{staged}/call={calls[-1]}"
    if not _there(spark, f"{last}/_SUCCESS"):
        return calls[-1], True
    own = ["doc_id", "points", "digest", "text_sha256"]
    told = lambda df: tuple(df.select(F.xxhash64(*own).cast("decimal(38,0)").alias("h"), F.xxhash64(F.lit("2"), *own).cast("decimal(38,0)").alias("g")).agg(F.count("*"), F.sum("h"), F.sum("g")).first())
    same = told(spark.read.parquet(last)) == told(narrow)
    return (calls[-1], False) if same else (calls[-1] + 1, True)


def _end_call(spark: SparkSession, base: str, call: int) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/ended/call={call}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True).close()


def find_copies(docs: DataFrame, state: str | None = None, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, call, locator of every row of this call and, with a state folder, of the calls before. digest may be replaced by a weaker one; results stay exact."""
    spark = docs.sparkSession
    base = state or scratch_path(spark, "exact")
    staged = f"{base}/staged"
    narrow = docs.select("doc_id", normal().alias("bytes"), F.length(whole_text()).alias("points")).select(F.col("doc_id").cast("long"), "points", digest(F.col("bytes")).alias("digest"), sha256(F.col("bytes")).alias("text_sha256"), F.monotonically_increasing_id().alias("locator"))
    call, new = _open_call(base, narrow) if state else (0, True)
    content = _remember(docs, f"{base}/content", call, digest) if state else None
    if new:
        narrow.write.mode("overwrite").parquet(f"{staged}/call={call}")
    schema = T.StructType([*narrow.schema, T.StructField("call", T.LongType())])
    rows = spark.read.schema(schema).parquet(staged)
    groups = materialise(keyed_state(spark, staged, schema, f"{base}/state"), "exact-groups")
    hits = groups.where("group_size > 1").select("digest")
    found = _extremes(_texts(docs, digest).join(sized_broadcast(hits), "digest")) if content is None else content.join(hits, "digest", "left_semi")
    bad = materialise(found.where("least <> most").select("digest"), "exact-collisions")
    if state:
        _end_call(spark, base, call)
    if not bad.isEmpty():
        # the digest named texts that differ: such rows are grouped anew by what their full bytes name
        bad = sized_broadcast(bad)
        again = rows.join(bad, "digest").groupBy("digest", "text_sha256").agg(F.max(_rank()).alias("k"), F.count("*").alias("group_size"))
        again = again.select("digest", "text_sha256", *_kept("k"), "group_size")
        joined = rows.join(bad, "digest", "left_anti").join(groups, "digest").unionByName(rows.join(again, ["digest", "text_sha256"]))
    else:
        joined = rows.join(groups, "digest")
    kept = (F.col("call") == F.col("keep_call")) & (F.col("locator") == F.col("keep_at"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "call", "locator")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies, all columns kept. Rows are taken out by id; only ids that stand on several rows, and null ids, need their texts shuffled."""
    found = materialise(find_copies(docs), "exact-found")
    dropped = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    kept = found.where("kept")
    # an id that is both kept and dropped stands on several rows
    unclear = materialise(kept.join(dropped, "doc_id", "left_semi").select("doc_id", "text_sha256"), "exact-unclear")
    out = docs.join(sized_broadcast(dropped), "doc_id", "left_anti").where(F.col("doc_id").isNotNull())
    marked = docs.withColumn("__sha", sha256(normal()))
    if not unclear.isEmpty():
        again = marked.join(sized_broadcast(unclear.select("doc_id", F.col("text_sha256").alias("__sha"))), ["doc_id", "__sha"], "left_semi")
        # copies of one text under one id differ in length at most by white space: the longest stays
        best = again.groupBy("doc_id", "__sha").agg(F.max_by(F.struct(*[again[c] for c in docs.columns]), F.length(whole_text())).alias("r"))
        out = out.unionByName(best.select("r.*"))
    if not found.where("doc_id is null").isEmpty():
        nameless = marked.where("doc_id is null")
        lone = kept.where("doc_id is null").select(F.col("text_sha256").alias("__sha"))
        best = nameless.join(lone, "__sha", "left_semi").groupBy("__sha").agg(F.max_by(F.struct(*[nameless[c] for c in docs.columns]), F.length(whole_text())).alias("r"))
        out = out.unionByName(best.select("r.*"))
    return out.select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(read_table(spark, sf_dir, "documents")).drop("call", "locator")


OP3_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id,
       first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by points desc, doc_id) = 1 as kept,
       text_sha256
from t
"""
