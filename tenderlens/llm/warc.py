"""WARC archives as a chunked record table.

A payload becomes rows of (page, chunk number, text of at most ``CHUNK_CHARS`` characters). Each
row is written as one WARC record: the first as ``response``, the others as ``continuation``
records of the same origin, so no record is larger than a chunk. A record's text ends in its block;
the line separator of Spark's text writer, two CRLF, is the end WARC asks for, so the files are
plain WARC, one after the other compressed as a whole (gzip). Reading streams the pieces of a file
through a parser that follows Content-Length and carries the SHA-1 from chunk to chunk.

Of pages with equal payloads of at least ``MIN_SHARED`` bytes, the one with the largest id is the
response, the others refer to it. A page id may repeat with different payloads; each row gets its
record. A null html is an empty payload; a null page id is written as such and never chosen as a
response while another page has the payload. Line ends in urls are percent-encoded; a null url
has no header. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderlens.llm.texts import bounded_batches
from tenderlens.sources.staging import shared_folder

CHUNK_CHARS = 1 << 18
MIN_SHARED = 1000
BREAK = "\r\n"
END = BREAK * 2
HTTP = f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{END}"

SCHEMA = """page_id long, url string, payload_bytes long, payload_digest string,
    record_type string, refers_to long, n_chunks long"""


def records(pages: DataFrame, key: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """One row per page: id, url, payload, its length and digest, and what it refers to."""
    page = pages.select(
        F.col(f"`{key}`").cast("long").alias("page"), F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("payload"))
    page = page.withColumn("size", F.octet_length("payload").cast("long")) \
        .withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    shared = (page.filter(F.col("size") >= MIN_SHARED).groupBy("digest")
              .agg(F.max("page").alias("target"), F.count("*").alias("copies"))
              .filter("copies > 1").drop("copies"))
    return (page.join(shared, "digest", "left")
            .withColumn("refers", F.when(~F.col("page").eqNullSafe(F.col("target")),
                                         F.col("target"))))


def _header(*fields: Column) -> Column:
    return F.concat_ws(BREAK, F.lit("WARC/1.1"), *fields)


def _field(name: str, value: Column) -> Column:
    """Null, and so left out by concat_ws, where the value is null."""
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _name(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def record_lines(found: DataFrame) -> DataFrame:
    """The text of each WARC record, chunks of a payload in order next to each other."""
    chunks = F.when(F.col("refers").isNotNull(), F.lit(1)).otherwise(
        F.greatest(F.ceil(F.length("payload") / CHUNK_CHARS), F.lit(1)).cast("int"))
    chunked = found.withColumn("chunks", chunks).withColumn(
        "chunk", F.explode(F.sequence(F.lit(1), F.col("chunks"))))
    part = F.expr(f"substring(payload, (chunk - 1) * {CHUNK_CHARS} + 1, {CHUNK_CHARS})")
    first = F.col("chunk") == 1
    kind = F.when(F.col("refers").isNotNull(), "revisit").when(first, "response") \
        .otherwise("continuation")
    body = F.when(F.col("refers").isNotNull(), F.lit(HTTP)).when(
        first, F.concat(F.lit(HTTP), part)).otherwise(part)
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = _header(
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        _field("WARC-Target-URI", url),
        _field("WARC-Page", F.coalesce(F.col("page").cast("string"), F.lit(""))),
        _field("WARC-Refers-To", F.when(F.col("refers").isNotNull(), _name(F.col("refers")))),
        _field("WARC-Segment-Origin-ID", F.when(~first, _name(F.col("page")))),
        _field("WARC-Segment-Number", F.when(F.col("chunks") > 1, F.col("chunk"))),
        _field("WARC-Segment-Total-Length",
               F.when((F.col("chunks") > 1) & (F.col("chunk") == F.col("chunks")), F.col("size"))),
        _field("WARC-Segments", F.when(first, F.col("chunks"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Payload-Length", F.col("size")),
        F.lit("Content-Type: application/http; msgtype=response"),
        _field("Content-Length", F.octet_length("body")))
    return chunked.withColumn("body", body).select(
        F.concat(header, F.lit(END), F.col("body")).alias("value"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Archives of all pages, one gzip file for each partition."""
    record_lines(records(pages)).write.option("lineSep", END).option("compression", "gzip") \
        .text(folder)


class _Parser:
    """Records from a stream of bytes; holds at most one record's header and block."""

    def __init__(self):
        self.held, self.need, self.header = bytearray(), -1, {}

    def feed(self, data: bytes):
        self.held += data
        while True:
            if self.need < 0:
                # A last block that ends in CRLF takes half of the separator behind it, so the
                # file's last piece is the other half, and one separator too many is fed.
                while self.held.startswith(b"\r\n\r\n"):
                    del self.held[:4]
                at = self.held.find(b"\r\n\r\n")
                if at < 0:
                    return
                lines = self.held[:at].decode().split(BREAK)
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record: {lines[0][:80]!r}")
                self.header = dict(line.split(": ", 1) for line in lines[1:])
                self.need = int(self.header["Content-Length"])
                del self.held[:at + 4]
            if len(self.held) < self.need + 4:
                return
            block = bytes(self.held[:self.need])
            del self.held[:self.need + 4]
            self.need = -1
            yield self.header, block


def _read(batches):
    """Rows of a file's records; digest and length are carried from chunk to chunk."""
    parser, rows = _Parser(), []
    left = 0
    for batch in batches:
        for piece in batch.column(0).to_pylist():
            for header, block in parser.feed(piece.encode() + b"\r\n\r\n"):
                kind = header["WARC-Type"]
                if kind == "revisit":
                    rows.append(_row(header, int(header["WARC-Payload-Length"]),
                                     header["WARC-Payload-Digest"].removeprefix("sha1:"), kind, 0))
                    continue
                if kind == "response":
                    if left:
                        raise ValueError("a continuation record is missing")
                    first, digest, size = header, hashlib.sha1(), 0
                    left = int(header["WARC-Segments"])
                    block = block[block.index(b"\r\n\r\n") + 4:]
                digest.update(block)
                size += len(block)
                left -= 1
                if left == 0:
                    if f"sha1:{digest.hexdigest()}" != first["WARC-Payload-Digest"]:
                        raise ValueError("the payload does not have the record's digest")
                    rows.append(_row(first, size, digest.hexdigest(), "response",
                                     int(first["WARC-Segments"])))
        if rows:
            yield _batch(rows)
            rows = []
    if left or parser.held or parser.need >= 0:
        raise ValueError("the archive ends inside a record")


def _row(header: dict, size: int, digest: str, kind: str, chunks: int) -> tuple:
    page, target = header["WARC-Page"], header.get("WARC-Refers-To")
    return (int(page) if page else None, header.get("WARC-Target-URI"), size, digest, kind,
            int(re.search(r"-?\d+", target)[0]) if target else None, chunks)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in SCHEMA.split(",")]
    kinds = [pa.string() if n in ("url", "payload_digest", "record_type") else pa.int64()
             for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page: the payload's length and digest, the record's type and what it refers to."""
    bounded_batches(spark)
    return spark.read.option("lineSep", END).text(folder).mapInArrow(_read, SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of all pages to the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return read_archives(spark, folder)


SQL = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html FROM pages
), s AS (
  SELECT page_id, url, octet_length(encode(html)) AS n, sha1(html) AS d, max(page_id)
         OVER (PARTITION BY html) AS target FROM p
)
SELECT page_id, url, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {MIN_SHARED} AND page_id <> target THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN n >= {MIN_SHARED} AND page_id <> target THEN target END AS refers_to
FROM s
"""
