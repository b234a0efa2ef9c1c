"""Counts, statistics and trends per month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.months import month_label


def month_range(rows: DataFrame, column: str = "shard") -> DataFrame:
    """Every month from the first to the last, empty ones included."""
    bounds = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return (bounds.where(F.col("lo").isNotNull())
            .select(F.explode(F.sequence("lo", "hi")).alias("shard")))


def counts_by_month(stories: DataFrame, scrapes: DataFrame) -> DataFrame:
    """story_count and scrape_count per month, and a total row with a null month."""
    both = (stories.groupBy("shard").agg(F.count(F.lit(1)).alias("story_count"),
                                         F.lit(0).cast("bigint").alias("scrape_count"))
            .unionByName(scrapes.groupBy("shard").agg(
                F.lit(0).cast("bigint").alias("story_count"),
                F.count(F.lit(1)).alias("scrape_count"))))
    # Already one row per month and table, so what follows moves a few thousand rows.
    empty = month_range(both).select(
        "shard", F.lit(0).cast("bigint").alias("story_count"),
        F.lit(0).cast("bigint").alias("scrape_count"))
    return (both.unionByName(empty).rollup("shard")
            .agg(F.sum("story_count").alias("story_count"),
                 F.sum("scrape_count").alias("scrape_count")))


def store_stats(scrapes: DataFrame) -> DataFrame:
    """count, earliest and latest (epoch seconds) per month."""
    return scrapes.groupBy("shard").agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.min(F.unix_seconds("date")), F.lit(0)).alias("earliest"),
        F.coalesce(F.max(F.unix_seconds("date")), F.lit(0)).alias("latest"))


def newest(stories: DataFrame) -> DataFrame:
    """The newest story's date, from the newest month alone."""
    last = stories.where(F.col("shard") == stories.agg(F.max("shard")).scalar())
    return last.agg(F.max("date").alias("now"))


def hits_by_month(hits: DataFrame, months: DataFrame) -> DataFrame:
    """Hits per month of ``months``, zero where there is none."""
    per_month = hits.groupBy("shard").agg(F.count(F.lit(1)).alias("hits"))
    return months.join(per_month, "shard", "left").select(
        "shard", F.coalesce("hits", F.lit(0)).alias("hits"))


def capped_count(hits: DataFrame, most: int) -> DataFrame:
    """Number of hits, at most ``most``; stops reading when the cap is reached."""
    return hits.limit(most).agg(F.count(F.lit(1)).alias("n"))


def trend(hits: DataFrame, stories: DataFrame, keep: int = 12) -> DataFrame:
    """Smoothed share of a search in each month's stories: label, ratio, smooth.

    Months are trimmed from the front while more than ``keep`` remain and the first three
    are all zero. One row per month enters the ordered windows, so they are small.
    """
    base = stories.groupBy("shard").agg(F.count(F.lit(1)).alias("total"))
    months = month_range(base).join(base, "shard", "left").withColumn(
        "total", F.coalesce("total", F.lit(0)))
    counted = hits.groupBy("shard").agg(F.count(F.lit(1)).alias("hits"))
    rows = months.join(counted, "shard", "left").select(
        "shard", F.when((F.col("total") == 0) | F.col("hits").isNull(), 0.0)
        .otherwise(F.col("hits") / F.col("total")).alias("raw"))
    order = Window.orderBy("shard")
    whole = Window.partitionBy()
    near = [F.col("raw"), F.lead("raw", 1).over(order), F.lead("raw", 2).over(order)]
    # Past the end there is no month that could be zero, so the trimming stops there.
    starts = (near[0] != 0) | F.coalesce(near[1] != 0, F.lit(True)) | F.coalesce(
        near[2] != 0, F.lit(True))
    marked = (rows.withColumn("_i", F.row_number().over(order) - 1)
              .withColumn("_n", F.count(F.lit(1)).over(whole))
              .withColumn("_starts", starts))
    first = F.coalesce(F.min(F.when(F.col("_starts"), F.col("_i"))).over(whole), F.col("_n"))
    kept = marked.withColumn("_from", F.least(
        first, F.greatest(F.col("_n") - keep, F.lit(0)))).where(F.col("_i") >= F.col("_from"))
    cur = F.when(F.col("raw") == 0, 1e-12).otherwise(F.col("raw"))
    rows = kept.select("shard", F.col("raw").alias("ratio"), cur.alias("_v"))
    v = F.col("_v")
    smooth = (F.coalesce(F.lag("_v").over(order), v) * 0.2 + v * 0.6
              + F.coalesce(F.lead("_v").over(order), v) * 0.2)
    return rows.select("shard", month_label(F.col("shard")).alias("label"), "ratio",
                       smooth.alias("smooth"))


def source_counts(stories: DataFrame) -> DataFrame:
    """Stories per (source, subsource); a story counts one scrape per source."""
    from ..functions.ids import parse_scrape_id
    rows = stories.select(F.explode("sources").alias("source", "scrape_id"))
    parsed = rows.select("source", parse_scrape_id(F.col("scrape_id"))["subsource"]
                         .alias("subsource"))
    return parsed.groupBy("source", "subsource").agg(F.count(F.lit(1)).alias("n"))


def metrics(stories: DataFrame, hot: DataFrame, tags: DataFrame) -> DataFrame:
    """Long form (metric, label, value) of the three metric families.

    ``tags`` is the top-tag table (tag, n) of the hot set.
    """
    by_month = stories.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("stories_by_shard").alias("metric"), month_label(F.col("shard")).alias("label"),
        F.col("n").alias("value"))
    by_tag = tags.select(F.lit("stories_by_tag").alias("metric"), F.col("tag").alias("label"),
                         F.col("n").alias("value"))
    by_source = source_counts(hot).select(
        F.lit("stories_by_source").alias("metric"),
        F.concat_ws(":", "source", "subsource").alias("label"), F.col("n").alias("value"))
    return by_month.unionByName(by_tag).unionByName(by_source)


def insert_summary(results: DataFrame) -> DataFrame:
    """merged / existing / new / not_found, from one ``result`` per story."""
    def n(name: str) -> Column:
        return F.coalesce(F.sum((F.col("result") == name).cast("bigint")), F.lit(0)).alias(name)

    return results.agg(n("merged"), n("existing"), n("new"), n("not_found"))


def add_summaries(summaries: DataFrame) -> DataFrame:
    return summaries.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c)
                           for c in ("merged", "existing", "new", "not_found")])
