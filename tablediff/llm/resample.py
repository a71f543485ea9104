"""Target-distribution importance resampling over hashed n-gram features.

A feature is a run of one to n consecutive words; its bucket is a hash of its bytes. A bucket's gain is the logarithm of how much
likelier it is in the target texts than in all documents; a document's weight is the sum over its features, and documents are
drawn by the highest weight plus Gumbel noise, which is sampling without replacement in proportion to the exponent of the weight.

Overlap chunking: a text over LONG_BYTES is split at word boundaries into chunks that are dealt out to all tasks. A chunk owns the
words that start in it and carries the n - 1 words after them, so each feature is counted once, by the chunk that owns its first word. Bucket counts
are written once (documents are read and cut into words once); the gains, a row for each bucket, go with the code of the second pass.
Counts and weights of chunks are summed by document. Ranks are places in a range-sorted table, counted for each range and offset
by the ranges before: no task sees all rows.

Cases: a null text has no words, like an empty one, and weight 0; a text of one unbroken word is one chunk, as no word is split. Ties in
score go to the smaller doc_id, null ids last (their noise is that of the empty id). Repeated rows are documents of their own: each is returned,
counted and ranked. Extra columns are ignored, whatever their names. An empty table of documents gives an empty result; an empty table of target
texts leaves gains that only count against frequent buckets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, released

#: Features: runs of one to NGRAM words in BUCKETS buckets; documents with LEAST_WORDS words take part, SHARE per cent of them are drawn.
NGRAM, BUCKETS, LEAST_WORDS, SHARE, SEED = 1, 10_000, 20, 10, 2024
#: Texts of more bytes are chunked; a chunk owns about CHUNK_BYTES.
LONG_BYTES, CHUNK_BYTES = 1 << 16, 1 << 15

#: What is no word becomes a blank, A-Z become a-z; bytes of other characters stay, so a text's UTF-8 can be cut as it is.
TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
FEATURES = "row long, doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"


def chunks(clean: bytes, n: int, size: int) -> Iterator[tuple[bytes, bytes]]:
    """(what the chunk owns, what it carries) of a cleaned text, cut at blanks after about size bytes; the carry is the n - 1 words that follow."""
    word, at = re.compile(rb"[^ ]+"), 0
    while at < len(clean):
        end = clean.find(b" ", at + size)
        end = len(clean) if end < 0 else end
        after, carried = word.finditer(clean, end), []
        while len(carried) < n - 1 and (m := next(after, None)):
            carried.append(m.group())
        yield clean[at:end], b" ".join(carried)
        at = end


def feature_hashes(own: list[bytes], carried: list[bytes], n: int) -> list[int]:
    """The hash of every run of one to n words that starts in own; a run's hash goes on from that of the run one word shorter."""
    words = own + carried
    held = list(map(crc32, own))
    out = list(held)
    spaced = [b" " + w for w in words] if n > 1 else []
    for k in range(1, n):
        held = list(map(crc32, spaced[k : k + len(own)], held))  # runs that would go beyond the text end here
        out += held
    return out


def _counted(owned: list[bytes], carried: list[bytes], n: int, buckets: int) -> tuple[list[int], list[int], pa.Array, pa.Array]:
    """Words and features of each text of a batch, and its distinct buckets with their counts."""
    n_words, sizes, hashes = [], [], []
    for text, carry in zip(owned, carried):
        own = text.split()
        found = feature_hashes(own, carry.split(), n)
        n_words.append(len(own))
        sizes.append(len(found))
        hashes.append(np.fromiter(found, np.uint32, len(found)))
    code = np.repeat(np.arange(len(sizes), dtype=np.int64) * buckets, sizes) + np.concatenate(hashes) % buckets
    code, count = np.unique(code, return_counts=True)
    offsets = pa.array(np.searchsorted(code, np.arange(len(sizes) + 1, dtype=np.int64) * buckets).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (code % buckets, count)]
    return n_words, sizes, *lists


def features(docs: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, long_bytes: int = LONG_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """row, doc_id, n_words, n_features and bucket counts of every text, or of every chunk of a long one; row names a long text and is null for others."""
    spark = docs.sparkSession

    def rows(own: list, ids, owned: list[bytes], carried: list[bytes]) -> Iterator[pa.RecordBatch]:
        words, sizes, found, count = _counted(owned, carried, n, buckets)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), ids, pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), found, count], ["row", "doc_id", "n_words", "n_features", "buckets", "counts"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t.translate(TABLE) for t in part.column("bytes").to_pylist()]
                yield from rows([None] * len(texts), part.column("doc_id"), texts, [b""] * len(texts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "chunk", "owned", "carried"]
        for batch in batches:
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("bytes")):
                held = []
                for i, two in enumerate(chunks(text.as_py().translate(TABLE), n, chunk_bytes)):
                    held.append((row, doc_id, i, *two))
                    if len(held) == 128:
                        yield _batch(held, names)
                        held = []
                if held:
                    yield _batch(held, names)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield from rows(part.column("row").to_pylist(), part.column("doc_id"), part.column("owned").to_pylist(), part.column("carried").to_pylist())

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    size = F.octet_length("bytes")
    whole = texts.where(size <= long_bytes).mapInArrow(released(short), FEATURES)
    pieces = texts.where(size > long_bytes).withColumn("row", F.monotonically_increasing_id()).mapInArrow(released(cut), "row long, doc_id long, chunk long, owned binary, carried binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return whole.unionByName(pieces.repartition(parts, "row", "chunk").mapInArrow(released(long), FEATURES))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def bucket_totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: summed in each task, then by bucket. No more than buckets numbers reach the driver, however many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("buckets").flatten().to_numpy(zero_copy_only=False), batch.column("counts").flatten().to_numpy(zero_copy_only=False))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document: a sum over its buckets, and over its chunks where it has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            each = gains[lists.flatten().to_numpy(zero_copy_only=False)] * batch.column("counts").flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            sums = np.diff(np.concatenate([[0], np.cumsum(each)])[ends])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "doc_id", "n_words", "n_features")] + [pa.array(sums, pa.int64())], ["row", "doc_id", "n_words", "n_features", "weight"])

    weighed = found.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long")
    names = ("n_words", "n_features", "weight")
    chunked = weighed.where("row is not null").groupBy("row").agg(F.min("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in names])
    return weighed.where("row is null").select("doc_id", *names).unionByName(chunked.select("doc_id", *names))


def gumbel(doc_id: str, seed: int) -> Column:
    """Thousandths of a Gumbel variate from the document's id, rounded down: the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(df: DataFrame) -> DataFrame:
    """df with rank, 1 for the highest score, ties by the smaller doc_id. The rows are dealt by ranges of that order and written once with their places in the range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__tie")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            at = np.arange(before + 1, before + n + 1)
            before += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int64()), pa.array(at, pa.int64())], [*batch.schema.names, "__part", "__place"])

    narrow = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__tie")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema)
    placed = materialise(narrow.mapInArrow(place, f"{schema}, __part long, __place long"), "resample-ranks")
    # a row for each range, so one task can add them up
    sizes, offset = sorted((r[0], r[1]) for r in placed.groupBy("__part").agg(F.max("__place")).collect()), {}
    total = 0
    for part, n in sizes:
        offset[part] = total
        total += n
    offsets = df.sparkSession.createDataFrame(list(offset.items()) or [(0, 0)], "__part long, __before long")
    return placed.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")


def resample(docs: DataFrame, target: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED, long_bytes: int = LONG_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that are not drawn. share is in per cent of the documents with least_words words; target has a column text."""
    found = materialise(features(docs, n, buckets, long_bytes, chunk_bytes), "resample-features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets, long_bytes, chunk_bytes)
    gains = bucket_gains(bucket_totals(found, buckets), bucket_totals(wanted, buckets))
    scored = weigh(found, gains).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    columns = ["doc_id", "n_features", "weight", "score"]
    places = ranked(scored.where(F.col("n_words") >= least_words).select(*columns))
    drawn = places.count() * share // 100
    out = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return out.unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w"
_STEP = "case when {c} % 2 = 1 then xor({c} // 2, 3988292384::bigint) else {c} // 2 end"
OP11_SQL = rf"""
with recursive bits as (
  select i as start, i::bigint as c, 0 as k from range(256) t(i)
  union all select start, {_STEP.format(c='c')}, k + 1 from bits where k < 8),
tab as (select list(c order by start) as t from bits where k = 8),
d as (select doc_id, {_WORDS} from documents),
b as (select {_WORDS} from benchmark),
v as (select w, hex(encode(w)) as h from (select w from d union select w from b)),
hashed as (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::int + 1, 2))::bigint)),
    lambda c, x: xor(c // 256, tab.t[(xor(c, x) & 255) + 1])), 4294967295::bigint) % 10000 as bucket from v cross join tab),
s as (select bucket, count(*) as n from d join hashed using (w) group by 1),
t as (select bucket, count(*) as n from b join hashed using (w) group by 1),
gains as (select s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select sum(n) from s) + 10000)::double / ((s.n + 1)::double * (coalesce((select sum(n) from t), 0) + 10000)::double)))::bigint as gain from s left join t using (bucket)),
w as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from d join hashed using (w) join gains using (bucket) group by 1),
scored as (
  select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from documents left join w using (doc_id)),
drawn as (select *, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 20)
select scored.*, case when place <= n * 10 // 100 then place end as rank from scored left join (select doc_id, place, n from drawn) using (doc_id)
"""
