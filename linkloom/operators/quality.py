"""Checks over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate(stories: DataFrame, links: DataFrame, scrapes: DataFrame) -> DataFrame:
    """Per month: stories, duplicate ids, null keys, links to no scrape, links of no story,
    stories without a link, and stories whose ``n_scrapes`` is not their number of links.

    A month with links but no story has a row as well. Links are counted per story before
    they meet the stories, so a hot story is one row in the join.
    """
    per_id = stories.groupBy("shard", "story_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.max((F.col("url_norm").isNull() | F.col("title").isNull() | F.col("date").isNull())
              .cast("int")).alias("bad_key"))
    per_month = per_id.groupBy("shard").agg(
        F.sum("copies").alias("stories"),
        F.sum((F.col("copies") > 1).cast("bigint")).alias("duplicate_ids"),
        F.sum("bad_key").alias("null_keys"))
    dangling = (links.join(scrapes.select(F.col("shard").alias("scrape_shard"), "scrape_id"),
                           ["scrape_shard", "scrape_id"], "left_anti")
                .groupBy("shard").agg(F.count(F.lit(1)).alias("dangling_links")))
    linked = links.groupBy("shard", "story_id").agg(F.count(F.lit(1)).alias("links"))
    told = stories.groupBy("shard", "story_id").agg(F.max("n_scrapes").alias("n_scrapes"))
    both = told.join(linked, ["shard", "story_id"], "full").groupBy("shard").agg(
        F.sum(F.when(F.col("n_scrapes").isNull(), F.col("links"))).alias("orphan_links"),
        F.sum((F.col("links").isNull() & F.col("n_scrapes").isNotNull()).cast("bigint")).alias("unlinked_stories"),
        F.sum((F.col("n_scrapes") != F.col("links")).cast("bigint")).alias("wrong_counts"))
    names = ("stories", "duplicate_ids", "null_keys", "dangling_links", "orphan_links",
             "unlinked_stories", "wrong_counts")
    return both.join(per_month, "shard", "left").join(dangling, "shard", "left").select(
        "shard", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def repeated_urls(stories: DataFrame) -> DataFrame:
    """URLs with more than one story in one month; a result should have none."""
    return (stories.groupBy("url_norm", "shard").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))
