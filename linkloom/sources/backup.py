"""Newline-delimited JSON backups of scrapes: writing, change detection, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.months import month_of
from ..operators.counts import month_range, store_stats

# Record name and payload fields per source, a fixed file format: field -> (column, type).
RECORDS = {
    "hacker_news": ("HackerNews", {"points": ("points", "BIGINT"), "comments": ("comments", "BIGINT"),
                                   "position": ("position", "BIGINT")}),
    "slashdot": ("Slashdot", {"num_comments": ("comments", "BIGINT"),
                              "tags": ("tags", "ARRAY<STRING>")}),
    "lobsters": ("Lobsters", {"num_comments": ("comments", "BIGINT"), "position": ("position", "BIGINT"),
                              "score": ("score", "BIGINT"), "tags": ("tags", "ARRAY<STRING>")}),
    "reddit": ("Reddit", {"flair": ("flair", "STRING"), "position": ("position", "BIGINT"),
                          "upvotes": ("upvotes", "BIGINT"), "downvotes": ("downvotes", "BIGINT"),
                          "num_comments": ("comments", "BIGINT"), "score": ("score", "BIGINT"),
                          "upvote_ratio": ("upvote_ratio", "FLOAT")}),
    "feed": ("Feed", {"tags": ("tags", "ARRAY<STRING>")}),
}


def to_record() -> Column:
    """JSON text of a scrape, wrapped in its record name; absent payloads are dropped."""
    wrapped = []
    for source, (name, fields) in RECORDS.items():
        body = F.struct(
            F.col("scrape_id").alias("id"), F.col("url"), F.col("raw_title"),
            F.unix_seconds("date").alias("date"),
            *[F.col(c).cast(t).alias(f) for f, (c, t) in fields.items()])
        wrapped.append(F.when(F.col("source") == source, body).alias(name))
    return F.to_json(F.struct(*wrapped))


def _record_schema() -> str:
    parts = []
    for name, fields in RECORDS.values():
        extra = ", ".join(f"{f}: {t}" for f, (_c, t) in fields.items())
        parts.append(f"{name}: STRUCT<id: STRING, url: STRING, raw_title: STRING, "
                     f"date: BIGINT, {extra}>")
    return f"STRUCT<{', '.join(parts)}>"


def _is_good() -> Column:
    return F.coalesce(F.col("_parsed").isNotNull() & F.col("_date").isNotNull() & F.col("url").isNotNull(), F.lit(False))


def _flat(lines: DataFrame, column: str, *carried: str) -> DataFrame:
    """The fields of every line, whatever record it holds; null where it holds none."""
    doc = F.from_json(F.col(column), _record_schema(), {"mode": "PERMISSIVE"})
    rows = lines.select(doc.alias("_d"), F.col(column).alias("_line"), *carried)
    columns: dict[str, Column] = {}
    source = F.lit(None).cast("string")
    for name_of, (name, fields) in RECORDS.items():
        here = F.col(f"_d.{name}")
        source = F.when(here.isNotNull(), F.lit(name_of)).otherwise(source)
        shared = {f: (f, None) for f in ("id", "url", "raw_title", "date")}
        for f, (c, _t) in {**shared, **fields}.items():
            value = F.when(here.isNotNull(), here[f])
            columns[c] = F.coalesce(columns[c], value) if c in columns else value
    flat = rows.select(source.alias("source"), "_line", *carried,
                       *[v.alias(f"_{c}" if c in ("id", "date") else c)
                         for c, v in columns.items()])
    return flat.withColumn("_parsed", ids.parse_scrape_id(F.col("_id")))


def from_records(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """Scrapes of backup lines. A bad line fails the job; ``strict=False`` drops it."""
    flat, parsed, good = _flat(lines, column), F.col("_parsed"), _is_good()
    # The URL is either its text or an array whose first entry is the text.
    raw_url = F.when(F.col("url").startswith("["),
                     F.get(F.from_json("url", "array<string>"), F.lit(0))).otherwise(F.col("url"))
    if strict:
        flat = flat.where(F.when(good, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("bad backup record: "), F.substring("_line", 1, 200)))
            .cast("boolean")))
    else:
        flat = flat.where(good)
    date = F.timestamp_seconds("_date")
    return flat.select(
        month_of(date).alias("shard"), F.col("_id").alias("scrape_id"), "source",
        parsed["subsource"].alias("subsource"), parsed["id"].alias("id"), raw_url.alias("url"),
        "raw_title", date.alias("date"), "position", "points", "comments", "score", "upvotes",
        "downvotes", "upvote_ratio", "flair", "tags")


def read_backup(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Scrapes of the files below ``path``, one record per line. A file's last line may be
    unfinished, without a line break: its writer was stopped. Any other broken line is an
    error; ``strict=False`` drops it.

    Whether a file has such a tail shows in its size, which then lacks a line break's byte. So
    the check is one row per file, and needs no order of lines.
    """
    pieces = (spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
              .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"),
                      (F.octet_length("value") + 1).alias("_bytes")))
    if strict:
        files = _flat(pieces, "value", "_file", "_size", "_bytes").groupBy("_file").agg(
            F.sum((~_is_good()).cast("bigint")).alias("bad"), (F.sum("_bytes") > F.max("_size")).cast("bigint").alias("tail"))
        broken = files.where("bad > tail").select("_file", "bad").limit(1).collect()
        if broken:
            raise ValueError(f"bad backup record in {broken[0]['_file']}")
    return from_records(pieces, "value", strict=False)


MANIFEST = "shard INT, count BIGINT, earliest BIGINT, latest BIGINT, content STRING"


def month_stats(scrapes: DataFrame) -> DataFrame:
    """Rows, dates and content of each month. ``content`` adds up a hash of every row, so it
    tells a changed row, whatever the order of rows."""
    own = F.xxhash64(*[F.col(c) for c in sorted(scrapes.columns)]).cast("decimal(20,0)")
    content = scrapes.groupBy("shard").agg(F.sum(own).cast("string").alias("content"))
    return store_stats(scrapes).join(content, "shard").select("shard", "count", "earliest", "latest", "content")


def changed_months(stats: DataFrame, manifest: DataFrame) -> DataFrame:
    """Months whose statistics differ from the last backup's manifest."""
    return stats.join(manifest, ["shard", "count", "earliest", "latest", "content"], "left_anti")


def backup(scrapes: DataFrame, manifest: DataFrame | None, path: str) -> DataFrame:
    """Write every changed month as ordered JSON lines; returns month, statistics and result:
    ``success``, ``no_change``, or ``empty`` for a month without rows between the first and
    the last, or in the manifest. What an emptied month had is left in the backup.

    Months are replaced one partition at a time and the caller stores the returned
    statistics as the next manifest only after this has succeeded.
    """
    stats = month_stats(scrapes)
    changed = stats if manifest is None else changed_months(stats, manifest)
    rows = scrapes.join(F.broadcast(changed.select("shard")), "shard", "left_semi")
    (rows.select("shard", "date", "scrape_id", to_record().alias("value"))
     .repartitionByRange("shard", "date", "scrape_id")
     .sortWithinPartitions("shard", "date", "scrape_id")
     .select("shard", "value")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("shard").text(path))
    months = stats.select("shard")
    if manifest is not None:
        months = months.unionByName(manifest.select("shard"))
    flagged = (month_range(months).select(F.col("shard").cast("int").alias("shard")).join(stats, "shard", "left")
               .join(changed.select("shard", F.lit(1).alias("_c")), "shard", "left"))
    return flagged.select("shard", F.coalesce("count", F.lit(0)).alias("count"), "earliest", "latest", "content", F.when(
        F.col("count").isNull(), "empty").when(F.col("_c") == 1, "success").otherwise("no_change").alias("result"))
