"""Content-addressed WARC archive.

A page becomes one WARC record. The archive keeps two tables: ``payloads``, one
row for each different payload (packed with zstd) under its SHA-256 digest, and ``records``, the
exact header block of every record with the digest of its payload. An original
record is the join of both on the digest; reading checks every payload against
its digest, once however many records share it, and fails on a mismatch.

Records whose payload is that of more than ``HOT_RECORDS`` others are dealt to several copies
of it: the copy's number is part of both joins' keys, so no digest gathers its records in one
task. At most ``MOST_HOT`` digests are split, which bounds what is broadcast to deal them.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the
largest page_id is a response and the others revisit it; smaller payloads are
always responses. Equality is decided by SHA-256; the header states the base32
SHA-1 digest that WARC readers expect.

Defined cases: null html is an empty payload; a null url gives an empty target
URI; a null page_id is never a response while another page has the payload;
rows that repeat page_id and payload are each a response record of their own; line breaks in a url are
percent-encoded, since a header cannot hold them; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, shared_dir, table

HOT_RECORDS = 5_000
MOST_HOT = 100_000
DATE = "2024-01-01T00:00:00Z"
BASE32_OF_CONV = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload) -> F.Column:
    """Base32 of the SHA-1 digest: ten hexadecimal digits are eight of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), *BASE32_OF_CONV)


def _line(name: str, value) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def written(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Write the archive of (page_id, url, html) rows below ``path``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id"), F.col("url"), payload.alias("payload"))
    thin = settled(rows.select("page_id", "url", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"), base32_sha1(F.col("payload")).alias("sha1")))
    owners = thin.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    # more than total / MOST_HOT records each, so MOST_HOT digests at most
    share = max(HOT_RECORDS, thin.count() // MOST_HOT)
    hot = owners.where(F.col("n") > share).select("digest", F.ceil(F.col("n") / share).cast("int").alias("copies"))
    thin = thin.join(F.broadcast(hot), "digest", "left").withColumn("copy", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("copies", F.lit(1))).cast("int"))
    owners = owners.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > share, F.ceil(F.col("n") / share).cast("int") - 1).otherwise(0))))
    typed = thin.join(owners, ["digest", "copy"])
    revisit = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    uri = F.coalesce(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("owner").cast("string"), F.lit(">"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    typed.select(header.cast("binary").alias("header"), "digest", "copy").write.option("compression", "zstd").parquet(f"{path}/records")
    # equal payloads meet after each task has reduced its own to one
    packed = rows.select("payload").mapInArrow(_pack, "digest string, packed binary")
    packed.groupBy("digest").agg(F.first("packed").alias("packed")).write.option("compression", "none").parquet(f"{path}/payloads")


def _pack(batches):
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        cells = [x.as_py() for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).hexdigest() for x in cells], pa.string()), pa.array([pack(x) for x in cells], pa.binary())], ["digest", "packed"])


def _checked(with_packed: bool):
    """Payloads that match their digests, with their sizes and SHA-1 digests."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, digests = [], []
            for digest, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                payload = unpack(packed.as_py())
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError("a payload does not match its digest")
                sizes.append(len(payload))
                digests.append(base64.b32encode(hashlib.sha1(payload).digest()).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), *[batch.column(1)] * with_packed], ["digest", "size", "sha1", *["packed"] * with_packed])

    return run


def payloads(spark: SparkSession, path: str, with_packed: bool = False) -> DataFrame:
    """(digest, copy, size, sha1[, packed]) of every payload, verified, once for each copy that records were dealt to."""
    found = spark.read.parquet(f"{path}/payloads").select("digest", "packed").mapInArrow(_checked(with_packed), "digest string, size long, sha1 string" + ", packed binary" * with_packed)
    copies = spark.read.parquet(f"{path}/records").groupBy("digest").agg(F.max("copy").alias("last"))
    return found.join(copies, "digest").withColumn("copy", F.explode(F.sequence(F.lit(0), "last"))).drop("last")


def _unpack(batches):
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        cells = [unpack(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], ["header", "digest", "payload"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(header, digest, payload) of every record, rebuilt by joining headers and payloads; payloads are verified."""
    joined = spark.read.parquet(f"{path}/records").join(payloads(spark, path, True), ["digest", "copy"]).select("header", "digest", "packed")
    return joined.mapInArrow(_unpack, "header binary, digest string, payload binary")


def record_bytes(rows: DataFrame) -> DataFrame:
    """Whole records as an archive file would hold them: header, body, two line breaks."""
    is_response = F.col("header").cast("string").contains("WARC-Type: response\r\n")
    body = F.when(is_response, F.col("payload")).otherwise(F.lit("").cast("binary"))
    return rows.select(F.concat(F.col("header"), body, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def _fields(rows: DataFrame, size, sha1) -> DataFrame:
    """The fields of each header beside its payload's size and digest; fails where the header states another digest."""
    text = F.col("header").cast("string")
    field = lambda name, value: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1), F.lit(""))
    stated = field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)")
    return rows.select(
        field("WARC-Record-ID", "<urn:page:([^>]*)>").cast("long").alias("page_id"),
        size.cast("long").alias("payload_bytes"),
        F.when(stated == sha1, stated).otherwise(F.raise_error(F.lit("a header does not state its payload's digest"))).alias("payload_digest"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:([^>]*)>").cast("long").alias("refers_to"),
    )


def parsed(rows: DataFrame) -> DataFrame:
    """The fields of rebuilt records."""
    return _fields(rows, F.octet_length("payload"), base32_sha1(F.col("payload")))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The fields of every record; payloads are read and verified once each and only their sizes and digests meet the headers."""
    return _fields(spark.read.parquet(f"{path}/records").join(payloads(spark, path), ["digest", "copy"]), F.col("size"), F.col("sha1"))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    written(table(spark, sf_dir, "pages"), path)
    return listed(spark, path)


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS owner FROM p
), digits AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1), '' ORDER BY i) AS payload_digest
  FROM d, (SELECT unnest(range(32)) AS i) GROUP BY page_id
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM d JOIN digits USING (page_id)
"""
