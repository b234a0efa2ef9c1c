"""Crawl plan: which URLs to fetch for which sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SourceConfig


def subsources(spark: SparkSession, cfg: SourceConfig = SourceConfig()) -> DataFrame:
    return spark.createDataFrame(
        [("reddit", s) for s in sorted(cfg.reddit.subreddits)], "source STRING, name STRING")


def reddit_urls(names: DataFrame, cfg: SourceConfig = SourceConfig()) -> DataFrame:
    """One URL per batch of subreddits, batched in name order. ``names`` is the list of
    configured subreddits, a handful of rows."""
    r = cfg.reddit
    n = F.row_number().over(Window.partitionBy("source").orderBy("name")) - 1
    before, after = r.api.split("${subreddits}")
    return (names.where("source = 'reddit'").select("source", "name")
            .withColumn("batch", F.floor(n / r.subreddit_batch))
            .groupBy("source", "batch")
            .agg(F.array_join(F.sort_array(F.collect_list("name")), "+").alias("_joined"))
            .select("source", F.concat(F.lit(before), "_joined", F.lit(after),
                                       F.lit(f"?limit={r.limit}")).alias("url")))


def crawl_plan(names: DataFrame, cfg: SourceConfig = SourceConfig()) -> DataFrame:
    """(source, url) to fetch."""
    fixed = ([("hacker_news", cfg.hacker_news_homepage + p) for p in cfg.hacker_news_pages]
             + [("slashdot", cfg.slashdot_homepage), ("lobsters", cfg.lobsters_feed)])
    return reddit_urls(names, cfg).unionByName(
        names.sparkSession.createDataFrame(fixed, "source STRING, url STRING"))
