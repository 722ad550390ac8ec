"""WARC archives of pages: writing with revisits and segments, reading with segment reassembly.

Writing: equal payloads (same SHA-1 and length) are one response, of the smallest page_id, and revisit
records that refer to it. A response is an HTTP message in chunked transfer framing; a block over
SEGMENT_BYTES is cut into a response (segment 1) and continuation records that name its record
ID as their origin. Records go out through Spark's text writer, whose line separator is the record
separator CRLF CRLF, gzipped, at most ARCHIVE_RECORDS to a file, so a file has a bounded size.

Reading: each file is walked by Content-Length. Whole records are decoded where they are read; only
segments are shuffled, grouped by origin, ordered by number, checked against the total length,
and unchunked. Revisits then find their response by record ID (a join of thin rows that AQE
splits where one response has a third of them).

Defined results: a null html is an empty payload; a null url gives no target URI; rows with a null
page_id are revisits if another row has their payload, else responses; repeated rows (same id
and payload) give equal records and as many result rows; an empty table gives an empty archive and an
empty result; further columns are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietcount.llm.common import in_arrow, new_path, pages

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
ARCHIVE_RECORDS = 2_000
MIN_REVISIT_BYTES = 0
BROADCAST_ROWS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SPACE = uuid.UUID("5f3b4c52-9a0e-4b57-8d0c-4d1c1c6f2b11")


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n" or len(out[-1]) < size:
            raise ValueError("broken chunk")
        at += 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head) else body


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'{page_id}:{digest}')}>"


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the CRLF CRLF that ends it."""
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + b"\r\n\r\n" + block


def page_records(page_id: int | None, url: str | None, payload: bytes | None, digest: str, first: int | None) -> Iterator[bytes]:
    """The records of a page; payload is None for a revisit of page `first`."""
    own = record_id(page_id, digest)
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    base = {"WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Page-Id": page_id}
    if payload is None:
        kind = {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first, digest)}
        yield record(kind | base, b"")
        return
    block = HTTP_HEAD + chunked(payload)
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    kind = {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response"}
    if len(parts) == 1:
        yield record(kind | base, block)
        return
    yield record(kind | base | {"WARC-Segment-Number": 1}, parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = {"WARC-Segment-Total-Length": len(block)} if n == len(parts) else {}
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'{own}:{n}')}>", "WARC-Date": DATE}
        yield record(more | {"WARC-Segment-Origin-ID": own, "WARC-Segment-Number": n} | total, part)


def write_archive(table: DataFrame, folder: str) -> None:
    """Archives page_id, url, html of every row under folder."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = table.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("n_bytes"))
    several = (
        rows.where(F.col("n_bytes") >= MIN_REVISIT_BYTES).groupBy("sha1", "n_bytes")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    )
    if several.count() <= BROADCAST_ROWS:  # otherwise both sides are shuffled
        several = F.broadcast(several)
    marked = rows.join(several, ["sha1", "n_bytes"], "left").withColumn("copied", F.col("first").isNotNull())
    revisit = F.col("copied") & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = marked.select("page_id", "url", F.when(~revisit, F.col("html").cast("binary")).alias("payload"), F.unhex("sha1").alias("sha1"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out: list[bytes] = []
                for page_id, url, payload, sha1, first in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                    out += page_records(page_id, url, payload, base32(sha1), first)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = in_arrow(marked, run, "value binary").select(F.col("value").cast("string"))
    writer = records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", ARCHIVE_RECORDS).text(folder)


def walk(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("the archive ends within a record")
        yield fields, block
        at = end + 4 + size + 4


def read_archive(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits).

    Raises if a segment is missing, a total length or a payload digest is wrong.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    schema = "origin string, page_id long, kind string, digest string, refers string, number int, total long, block binary, n_bytes long, payload binary"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                for f, block in walk(gzip.decompress(content.as_py())):
                    number = f.get("warc-segment-number")
                    row = {
                        "origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "kind": f["warc-type"],
                        "page_id": int(f["warc-page-id"]) if "warc-page-id" in f else None,
                        "digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers": f.get("warc-refers-to"),
                        "number": int(number or 1), "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None,
                        "block": block if number else None, "n_bytes": None, "payload": None,
                    }
                    if not number and row["kind"] == "response":
                        payload = checked(payload_of(block), row["digest"])
                        row |= {"n_bytes": len(payload), "payload": payload if with_payload else None}
                    rows.append(row)
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=wire)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=wire)

    wire = pa.schema(
        [("origin", pa.string()), ("page_id", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("refers", pa.string()),
         ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("n_bytes", pa.int64()), ("payload", pa.binary())]
    )

    def checked(payload: bytes, digest: str) -> bytes:
        if base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError(f"payload digest differs from {digest}")
        return payload

    parts = in_arrow(files, unpack, schema)
    # equal records of repeated rows are told by their copies of segment 1
    per_segment = parts.groupBy("origin", "number").agg(
        F.count(F.lit(1)).alias("copies"), *[F.first(c, True).alias(c) for c in ("page_id", "kind", "digest", "refers", "total", "block", "n_bytes", "payload")]
    )
    first = F.col("number") == 1
    whole = per_segment.groupBy("origin").agg(
        *[F.first(F.when(first, F.col(c)), True).alias(c) for c in ("copies", "page_id", "kind", "digest", "refers", "n_bytes", "payload")],
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("number", "block")))).alias("segments"),
    )
    wire_out = pa.schema([("origin", pa.string()), ("copies", pa.int64()), ("page_id", pa.int64()), ("kind", pa.string()), ("digest", pa.string()),
                          ("refers", pa.string()), ("n_bytes", pa.int64()), ("payload", pa.binary())])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                for row in rows:
                    if row["segments"]:
                        block = b"".join(s["block"] for s in row["segments"])
                        if [s["number"] for s in row["segments"]] != [*range(1, len(row["segments"]) + 1)] or row["total"] != len(block):
                            raise ValueError(f"segments of {row['origin']} are missing")
                        payload = checked(payload_of(block), row["digest"])
                        row |= {"n_bytes": len(payload), "payload": payload if with_payload else None}
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in wire_out.names} for r in rows], schema=wire_out)

    done = in_arrow(
        whole, reassemble, "origin string, copies long, page_id long, kind string, digest string, refers string, n_bytes long, payload binary"
    )
    responses = done.where("kind = 'response'").select(F.col("origin").alias("refers"), F.col("page_id").alias("refers_to"), F.col("n_bytes").alias("n"))
    out = done.join(responses, "refers", "left").select(
        "page_id",
        F.coalesce("n_bytes", "n").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
        *(["payload"] if with_payload else []),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    )
    return out.drop("copy")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    write_archive(pages(spark, sf_dir), folder)
    return read_archive(spark, folder)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
    list_aggregate([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (j // 4) + 1, 5))::INTEGER >> (15 - 5 * (j % 4))) & 31) + 1, 1)
      for j in range(32)], 'string_agg', '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""

QUERIES = {"op5_warc": op5_warc}
ORACLES = {"op5_warc": ORACLE}
