"""WARC archives: writing with segmentation and revisits, and reading back with reassembly.

A page becomes an HTTP response with chunked transfer framing. A block longer than SEGMENT_BYTES is cut into
a first record and continuation records, which name the first one as their origin, count up, and end with
the total length. Of pages with equal payloads the smallest page_id is the response, the others are revisits.

Archives are written and read by Spark, so they may lie in any store that it knows. Archives of others are read too: of versions
1.0 and 1.1, plain or with a gzip member for each record. Reading splits files at START and joins what a record's length shows
to belong together, so START may stand in a block; only where a plain file is dealt to several tasks just there the job ends with
an error. The writer places chunk ends so that START never appears inside a block.
Every record's length is checked against its header. Continuations are grouped by origin, ordered by segment number, counted and
measured against the total length; only segmented records are shuffled. Payloads are then unframed and their
digests recomputed; a header's digest may name the payload or, as some writers do, the framed body. A revisit that names a page
must agree with a response of it in digest and length. Anything that does not agree ends the job with an error.

Cases: null html is an empty payload, null url leaves the target out, a null page_id comes back as null and
revisits any real one with an equal payload. Repeated rows of one page_id with equal payloads are all
responses. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, released, scratch_path, sized_broadcast

SEGMENT_BYTES, CHUNK_BYTES, LEAST_REVISIT_BYTES = 32_768, 8_192, 0
#: Records of one archive file at most; bounds what a lost task has to write again.
RECORDS_PER_FILE = 50_000
#: Bytes of records that reading hands on at once.
HELD_BYTES = 16 << 20
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
#: What reading splits at, of every version. It does not begin anew within itself, so a reader that meets part of it at the end of a buffer can go on.
START = b"WARC/1."
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
FIELDS = "record_id string, kind string, uri string, page_id long, digest string, payload_bytes long, refers_to long, origin string, segment int, total long, block binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing. A chunk also ends inside each START that the payload may hold, so none is left in the block."""
    cuts = set(range(size, len(payload), size))
    cuts.update(m.start() + 4 for m in re.finditer(re.escape(START), payload))
    edges = [0, *sorted(c for c in cuts if 0 < c < len(payload)), len(payload)]
    out = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(edges, edges[1:]) if b > a]
    return b"".join(out) + b"0\r\n\r\n"


def body_of(block: bytes) -> bytes:
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("HTTP header does not end")
    return body


def unframe(block: bytes) -> bytes:
    """The payload of an HTTP response block; decodes chunked framing, with extensions and trailers, where the headers name it."""
    body = body_of(block)
    head = block[: len(block) - len(body)]
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line does not end")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is shorter than its size line says")
        out.append(body[at : at + size])
        at += size + 2


def _cut(block: bytes, size: int) -> list[bytes]:
    """Segments of at most size bytes, one at least."""
    return [block[at : at + size] for at in range(0, max(len(block), 1), size)]


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]|(?<=WARC)/", lambda m: f"%{ord(m[0]):02X}", str(v))
    return VERSION + b"\r\n" + b"".join(f"{k}: {clean(v)}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def records(page_id, url, payload: bytes, key: str, payload_digest: str, refers_to=None, revisit: bool = False, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page without their closing line ends."""
    name = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{n}')}>"
    head = [("WARC-Target-URI", url), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Page-ID", page_id)]
    if revisit:
        extra = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page", refers_to), ("WARC-Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(HTTP))]
        return [_header([("WARC-Type", "revisit"), ("WARC-Record-ID", name(1)), *head, *extra]) + HTTP]
    parts = _cut(HTTP + frame(payload), segment_bytes)
    out = []
    for i, part in enumerate(parts, 1):
        first = [("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *head, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1 if len(parts) > 1 else None)]
        later = [("WARC-Type", "continuation"), ("WARC-Record-ID", name(i)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name(1)), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", sum(map(len, parts)) if i == len(parts) else None)]
        out.append(_header([*(first if i == 1 else later), ("Content-Length", len(part))]) + part)
    return out


def _fields(head: bytes) -> dict[str, str]:
    """Header fields after the version line, names in lower case, continued lines joined."""
    fields: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] = f"{fields[last]} {line.strip()}".strip()
            continue
        key, _, value = line.partition(":")
        last = key.strip().lower()
        fields[last] = value.strip()
    return fields


def whole_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Records from what stands between one START and the next, in order: a piece whose header or block goes on takes in those after it."""
    held: list[bytes] = []
    have, need = 0, None
    for piece in pieces:
        if not held and not piece.strip(b"\r\n"):
            continue  # before the first record of a file
        held.append(START + piece)
        have += len(held[-1])
        if need is None:
            held = [b"".join(held)]
            end = held[0].find(END)
            if end < 0:
                continue
            size = _fields(held[0][:end]).get("content-length", "")
            if not size.isdigit():
                raise ValueError("record header has no length")
            need = end + len(END) + int(size)
        if have >= need:
            yield b"".join(held)
            held, have, need = [], 0, None
    if held:
        raise ValueError("archive ends within a record")


def parse_record(raw: bytes) -> dict:
    """One record from its version line on; only line ends may follow its length."""
    head, found, block = raw.partition(END)
    if not found or not head.startswith(START):
        raise ValueError("record header does not begin or does not end")
    fields = _fields(head)
    size = int(fields["content-length"])
    if len(block) < size or block[size:].strip(b"\r\n"):
        raise ValueError(f"record {fields.get('warc-record-id')} has {len(block)} bytes, its header says {size}")
    number = lambda k: int(fields[k]) if k in fields else None
    named = fields.get("warc-payload-digest", "")
    return {"record_id": fields.get("warc-record-id"), "kind": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "page_id": number("warc-page-id"), "digest": named[5:].upper() if named.lower().startswith("sha1:") else None, "payload_bytes": number("warc-payload-length"), "refers_to": number("warc-refers-to-page"), "origin": fields.get("warc-segment-origin-id"), "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"), "block": block[:size]}


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, least: int = LEAST_REVISIT_BYTES) -> None:
    """Writes a record (or its segments) for every row of pages under path, compressed."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    same = rows.where(F.col("n") >= least).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("sha", "n", "first")
    same = materialise(same, "warc-same")
    own = rows.join(sized_broadcast(same).withColumn("again", F.lit(True)), ["sha", "n"], "left")
    own = own.select("page_id", "url", "payload", "first", (F.coalesce("again", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    out += records(r["page_id"], r["url"], r["payload"], f"{r['page_id']}/{r['row']}", digest(r["payload"]), r["first"], r["revisit"], segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    framed = own.mapInArrow(released(run), "record binary").select(F.col("record").cast("string").alias("value"))
    framed.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record under path, with the fields named in FIELDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in FIELDS.split(", "))])
        out, size = [], 0
        for record in whole_records(r.as_py() for batch in batches for r in batch.column(0)):
            out.append(parse_record(record))
            size += len(record)
            if len(out) == 256 or size > HELD_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    lines = spark.read.option("lineSep", START.decode()).option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(released(run), FIELDS)


def reassemble(found: DataFrame) -> DataFrame:
    """The records with every segmented one put together again; columns as in FIELDS."""
    whole = found.where("segment is null")
    parts = found.where("segment is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = parts.groupBy("origin").agg(*[first(c) for c in ("kind", "uri", "page_id", "digest", "payload_bytes", "refers_to")], F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    block = F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.block))")
    joined = joined.withColumn("block", block)
    right = (F.size("parts") == F.element_at("parts", -1)["segment"]) & (F.element_at("parts", 1)["segment"] == 1) & F.col("total").isNotNull() & (F.octet_length("block") == F.col("total"))
    joined = joined.withColumn("block", F.when(right, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments of "), "origin", F.lit(" are not whole"))).cast("binary")))
    shape = [F.col("origin").alias("record_id"), *(F.col(c) for c in ("kind", "uri", "page_id", "digest", "payload_bytes", "refers_to")), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("int").alias("segment"), "total", "block"]
    return whole.unionByName(joined.select(*shape))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, uri, page_id, record_type, payload, payload_bytes, payload_digest, refers_to of every response and revisit; a revisit's payload is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    payload = own = None
                    if r["kind"] == "response":
                        payload = unframe(r["block"])
                        own = digest(payload)
                        if r["digest"] and r["digest"] not in (own, digest(body_of(r["block"]))):
                            raise ValueError(f"payload of {r['record_id']} does not have the digest in its header")
                    out.append((r["record_id"], r["uri"], r["page_id"], r["kind"], payload, r["payload_bytes"] if payload is None else len(payload), own or r["digest"], r["refers_to"]))
                cols = list(zip(*out)) or [()] * 8
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["record_id", "uri", "page_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])

    return reassemble(read_records(spark, path)).where("kind in ('response', 'revisit')").mapInArrow(released(run), "record_id string, uri string, page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def check_revisits(found: DataFrame) -> DataFrame:
    """found, if every revisit that names a page agrees with a response of that page in digest and length. Equal revisits are combined before the shuffle."""
    same = ["refers_to", "payload_digest", "payload_bytes"]
    named = found.where("record_type = 'revisit' and refers_to is not null").select(*same).distinct()
    there = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *same[1:])
    lost = named.join(there, same, "left_anti").first()
    if lost is not None:
        raise ValueError(f"a revisit of page {lost.refers_to} does not agree with any response of it")
    return found


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return check_revisits(materialise(found, "warc-read"))


def _base32_sql(hex40: str) -> str:
    parts = " || ".join(f"to_base(cast('0x' || substr({hex40}, {1 + 10 * i}, 10) as bigint), 32, 8)" for i in range(4))
    return f"translate({parts}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


OP8_SQL = f"""
with t as (select page_id, coalesce(html, '') as p, sha1(coalesce(html, '')) as h from pages),
g as (select page_id, cast(strlen(p) as bigint) as payload_bytes, upper(h) as h, min(page_id) over (partition by p) as first from t)
select page_id, payload_bytes, {_base32_sql('h')} as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from g
"""
