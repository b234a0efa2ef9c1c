"""WARC archives with revisit records, written and resolved by payload digest.

Writing: the payloads' digests are grouped (headers only, never payloads); of equal payloads
of at least ``least`` bytes the one with the smallest id stays a response, the others become
revisit records that refer to it and carry no payload. Records get fresh WARC and HTTP
headers. They are written by Spark's text writer with the record end ``CRLF CRLF`` as line
separator, so any storage that Spark can reach will do, and its commit protocol keeps a lost
executor from leaving half an archive. Archives are cut at about ``archive_bytes``.

Reading: each archive is parsed by its Content-Length fields, whatever the payloads contain.
Resolving joins revisit records to their responses by digest, on headers only; a digest
with a third of all records is one row on the responses' side, and adaptive execution splits
the other.

Defined results: a null html is an empty payload; payloads under ``least`` bytes are always
responses; rows that repeat the smallest id of a digest are responses as well; a row without
an id is a response unless another row of its digest has one; line breaks in a URL are
percent-encoded; a null URL is left out of the headers; an empty table gives an empty archive
and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from linkloom.llm.common import fresh_path, settle, small_batches

# Fixed values of the format.
END = "\r\n\r\n"
ID = "<urn:page:{}>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 100
ARCHIVE_BYTES = 16_000_000


def headers(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, payload_digest, payload_bytes) of every page, settled in the shared folder."""
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    return settle(pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.sha2(payload, 256).alias("payload_digest"),
                               F.octet_length(payload).cast("long").alias("payload_bytes")))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                  least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the pages as gzip-compressed WARC files below ``path``."""
    c = F.col
    heads = headers(pages, page_id, html)
    first = (heads.where(c("payload_bytes") >= least).groupBy("payload_digest")
             .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
             .where("_copies > 1").select(c("payload_digest").alias("_digest"), "_first"))
    total = heads.agg(F.sum("payload_bytes")).first()[0] or 0
    payload = F.coalesce(c(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(c(f"`{page_id}`").cast("long").alias("page_id"), c(f"`{url}`").cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # Which rows revisit is found on headers; the payloads are shuffled once, by page.
    again = (heads.join(first, c("payload_digest") == c("_digest")).where(~c("page_id").eqNullSafe(c("_first")))
             .select("page_id", c("_digest").alias("digest"), "_first").distinct())
    files = max(1, math.ceil(total / archive_bytes))
    # Null-safe equality as plain columns, so that the join keeps the partitions of the files.
    key = {"_none": c("page_id").isNull(), "_id": F.coalesce("page_id", F.lit(0).cast("long"))}
    again = again.withColumns(key).drop("page_id")
    rows = rows.withColumns(key).repartition(files, "_none", "_id", "digest").join(again, ["_none", "_id", "digest"], "left")
    revisit = c("_first").isNotNull()
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    size.cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, c("payload")))
    name = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("none")), F.lit(">\r\n"))
    target = F.replace(F.replace(c("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(c("page_id")),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), target, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Date: "), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), c("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(c("_first")), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END), block)
    (rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path))


RECORD = StructType([StructField("page_id", LongType()), StructField("record_type", StringType()),
                     StructField("url", StringType()), StructField("payload_digest", StringType()),
                     StructField("refers_to", LongType()), StructField("payload", BinaryType())])


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive, in order."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")[1:])
        body = data[stop + 4:stop + 4 + int(fields["Content-Length"])]
        at = stop + 4 + len(body) + len(END)
        number = lambda x: None if x is None or x == ID.format("none") else int(x[len("<urn:page:"):-1])
        kind = fields["WARC-Type"]
        payload = body[body.index(b"\r\n\r\n") + 4:] if kind == "response" else None
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        yield (number(fields["WARC-Record-ID"]), kind, fields.get("WARC-Target-URI"), digest,
               number(fields.get("WARC-Refers-To")), payload)


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows: list[tuple] = []
            for row in parse(gzip.decompress(content)):
                rows.append(row)
                if len(rows) >= 500:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=RECORD.names)
    for name in ("page_id", "refers_to"):
        out[name] = out[name].astype("Int64")
    return out


def read_archive(spark, path: str) -> DataFrame:
    """The records below ``path`` as they are written, each payload checked against its digest."""
    small_batches(spark, 1)  # one archive at a time
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(_parse_files, RECORD)


def resolve(records: DataFrame, payload: bool = False) -> DataFrame:
    """Each record with the bytes (and, if asked for, the payload) of the response it stands for."""
    c = F.col
    full = records.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    kept = ["payload_bytes"] + ["payload"] * payload
    slim = full.select("page_id", "record_type", "url", "payload_digest", "refers_to", *kept)
    if not payload:
        slim = settle(slim)  # headers only; the archives are parsed once
    found = (slim.where("record_type = 'response'").groupBy(c("payload_digest").alias("_digest"))
             .agg(*[F.first(x).alias(f"_{x}") for x in kept]))
    own = slim.where("record_type = 'response'")
    again = (slim.where("record_type = 'revisit'").drop(*kept).join(found, c("payload_digest") == c("_digest"), "left")
             .withColumnsRenamed({f"_{x}": x for x in kept}).select(*own.columns))
    return own.unionByName(again)


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages into a fresh archive in the shared folder and give its resolved records."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archive(pages, path, page_id, url, html)
    return resolve(read_archive(spark, path))
