"""Archives: written, read back, resolved."""
import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkloom.llm import queries, warc
from linkloom.llm.common import fresh_path

PAGES = "page_id LONG, url STRING, html STRING"


def plain(rows):
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = data in first and first[data] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


HARD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n" * 3
ROWS = ([(i, f"http://h/{i}", "copy é 😀 " * 30) for i in (9, 4, 7, 12)] + [(1, None, None), (2, "http://x/\r\nInjected: 1", ""),
        (3, "u", "short"), (5, "u", "short"), (20, "u", HARD), (21, "u", HARD), (22, "u", "y" * 99), (23, "u", "y" * 99), (24, "u", "y" * 100),
        (25, "u", "y" * 100), (4, "again", "copy é 😀 " * 30), (None, "n", "copy é 😀 " * 30), (None, "n", "z" * 200), (30, "u", "long " * 400_000)])


def test_records_come_back(spark):
    got = warc.archive(spark.createDataFrame(ROWS, PAGES).withColumn("digest", F.lit(1)).withColumn("payload", F.lit("old")))
    assert rows_of(got) == plain(ROWS)


def test_payloads_and_urls(spark):
    path = fresh_path(spark, "warc-test")
    pages = spark.createDataFrame(ROWS, PAGES)
    warc.write_archive(pages, path, archive_bytes=3000)
    records = warc.read_archive(spark, path)
    raw = {(r.page_id, r.url): r for r in records.collect()}
    assert raw[2, "http://x/%0D%0AInjected: 1"].record_type == "response" and raw[1, None].payload == b""
    assert all((r.payload is None) == (r.record_type == "revisit") for r in raw.values())
    full = warc.resolve(records, payload=True).collect()
    want = sorted(((i, (h or "").encode()) for i, _, h in ROWS), key=str)
    assert sorted(((r.page_id, bytes(r.payload)) for r in full), key=str) == want


def test_damage_is_noticed():
    body = b"HTTP/1.1 200 OK\r\n\r\nabc"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: {len(body)}\r\n\r\n"
    with pytest.raises(ValueError, match="damaged"):
        list(warc.parse(head.encode() + body + b"\r\n\r\n"))


def test_query_over_a_whole_table(spark, sf):
    rows = [tuple(r) for r in pd.read_parquet(f"{sf}/pages.parquet")[["page_id", "url", "html"]].itertuples(index=False)]
    assert rows_of(queries.QUERIES["op7_warc_revisits"](spark, sf)) == plain(rows)


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0
