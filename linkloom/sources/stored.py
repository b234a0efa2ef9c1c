"""Scans of the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.months import month_of
from ..operators.ordinals import with_place


def only_years(scrapes: DataFrame, years: list[int]) -> DataFrame:
    """Scrapes of the given years. The month bounds prune partitions; months never cross
    a year, so they also decide the rows."""
    spans = F.lit(False)
    for y in sorted(set(years)):
        spans = spans | F.col("shard").between(y * 12, y * 12 + 11)
    return scrapes.where(spans)


@dataclass
class Scan:
    """``rows`` in order, with their ``place``; ``errors`` (file, id, message) instead of rows
    that make no sense. The rest is read."""
    rows: DataFrame
    errors: DataFrame


def scan_month(rows: DataFrame, shard: int, key: str = "scrape_id") -> Scan:
    """One month of scrapes or stories in (date, id) order; other partitions are not read."""
    return _scan(rows.where(F.col("shard") == shard), ["date", key], key)


def scan_range(rows: DataFrame, first: int | None = None, last: int | None = None, key: str = "story_id") -> Scan:
    """All rows from month to month (all months without bounds) in (month, date, id) order.
    The place is counted over all of them, with no partition that holds more than its share."""
    here = rows
    if first is not None:
        here = here.where(F.col("shard") >= first)
    if last is not None:
        here = here.where(F.col("shard") <= last)
    return _scan(here, ["shard", "date", key], key)


def _scan(rows: DataFrame, order: list[str], key: str) -> Scan:
    problem = undecodable(rows.columns, key)
    marked = rows.withColumns({"_problem": problem, "_file": _file_of(rows)})
    errors = marked.where(F.col("_problem").isNotNull()).select(
        F.col("_file").alias("file"), F.col(key).alias("id"), F.col("_problem").alias("message"))
    return Scan(with_place(rows.where(problem.isNull()), order).orderBy("place"), errors)


def _file_of(rows: DataFrame) -> Column:
    """The file of a row, null for rows that do not come straight from files."""
    try:
        rows.select("_metadata.file_path").schema
    except AnalysisException:
        return F.lit(None).cast("string")
    return F.col("_metadata.file_path")


def undecodable(columns: list[str], key: str) -> Column:
    """What keeps a stored row from being used; null for a good row."""
    checks = [F.when(F.col(key).isNull(), "missing id"), F.when(F.col("date").isNull(), "missing date")]
    if key == "scrape_id":
        checks += [F.when(F.coalesce(ids.parse_scrape_id(F.col(key)).isNull(), F.lit(True)), "bad id"),
                   F.when(F.col("url").isNull(), "missing url")]
    if "url_norm" in columns:
        checks.append(F.when(F.col("url_norm").isNull(), "missing url"))
    checks.append(F.when(~F.coalesce(F.col("shard") == month_of(F.col("date")), F.lit(False)), "wrong month"))
    return F.coalesce(*checks)


def unreadable_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, message) of the Parquet files below ``path`` that cannot be read, or not to their
    end. The list comes from the file system; a file that a tolerant read of all columns
    returns no row of is broken, since none is written without rows."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
             .load(path).select(F.col("path").alias("file")))
    table = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    row = F.xxhash64(F.to_json(F.struct(*table.columns)))
    read = (table.select(F.col("_metadata.file_path").alias("_path"), row.alias("_row"))
            .groupBy("_path").agg(F.max("_row").alias("_any")))
    same = F.regexp_replace("file", "^file:/+", "/") == F.regexp_replace("_path", "^file:/+", "/")
    return files.join(read, same, "left_anti").select("file", F.lit("unreadable file").alias("message"))
