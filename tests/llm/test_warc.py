import base64
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F
from strandloom.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string, header string"
ROWS = [(1, "http://a/\r\nx", "same é", "d", "h"), (2, None, None, None, None), (3, "u", "", None, None), (9, "u", "same é", None, None), (4, "u", "other" * 50000, None, None), (9, "u", "same é", None, None), (None, "n", "same é", None, None)]


def archive(spark, tmp_path, rows, **kw):
    path = f"file://{tmp_path}/w"
    W.written(spark.createDataFrame(rows, SCHEMA), path, **kw)
    return W.records(spark, path)


def test_round_trip(spark, tmp_path):
    rows = archive(spark, tmp_path, ROWS)
    got = sorted((tuple(r) for r in W.parsed(rows).collect()), key=repr)
    want = []
    for page, _, html, *_ in ROWS:
        body = (html or "").encode()
        owner = max((p for p, _, h, *_ in ROWS if (h or "") == (html or "") and p is not None))
        kind = "response" if page == owner else "revisit"
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, None if kind == "response" else owner))
    assert got == sorted(want, key=repr)
    assert sorted((tuple(r) for r in W.listed(spark, f"file://{tmp_path}/w").collect()), key=repr) == got
    whole = [bytes(r.record) for r in W.record_bytes(rows).collect()]
    for r in whole:
        head, _, rest = r.partition(b"\r\n\r\n")
        size = int(head.rpartition(b"Content-Length: ")[2])
        assert len(rest) == size + 4 and head.startswith(b"WARC/1.1\r\n")
    assert spark.read.parquet(f"file://{tmp_path}/w/payloads").count() == 3


def test_a_common_payload_is_dealt_to_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "HOT_RECORDS", 10)
    rows = [(i, f"u{i}", "the empty page" if i % 2 else f"page {i}", None, None) for i in range(200)] + [(None, "n", "the empty page", None, None)]
    got = sorted((tuple(r) for r in W.parsed(archive(spark, tmp_path, rows)).collect()), key=repr)
    assert got == sorted((tuple(r) for r in W.listed(spark, f"file://{tmp_path}/w").collect()), key=repr)
    assert {(r[0], r[3], r[4]) for r in got} == {(i, "response" if i in (199, i // 2 * 2) and (i == 199 or i % 2 == 0) else "revisit", 199 if i % 2 and i != 199 else None) for i in range(200)} | {(None, "revisit", 199)}
    held = spark.read.parquet(f"file://{tmp_path}/w/records").where(F.col("header").cast("string").contains("revisit")).groupBy("copy").count().collect()
    assert len(held) == 11 and max(r["count"] for r in held) < 40
    assert spark.read.parquet(f"file://{tmp_path}/w/payloads").count() == 101


def test_small_payloads_stay_responses(spark, tmp_path):
    kinds = [r.record_type for r in W.parsed(archive(spark, tmp_path, ROWS, min_bytes=100)).collect()]
    assert set(kinds) == {"response"}


def test_a_damaged_payload_is_found(spark, tmp_path):
    archive(spark, tmp_path, ROWS[:1])
    bad = f"file://{tmp_path}/bad"
    good = spark.read.parquet(f"file://{tmp_path}/w/payloads")
    good.select("digest", F.lit(zstandard.compress(b"changed")).alias("packed")).write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"file://{tmp_path}/w/records").write.parquet(f"{bad}/records")
    with pytest.raises(Exception, match="does not match"):
        W.parsed(W.records(spark, bad)).collect()
    with pytest.raises(Exception, match="does not match"):
        W.listed(spark, bad).collect()


def test_empty(spark, tmp_path):
    assert W.parsed(archive(spark, tmp_path, [])).collect() == []
