"""Lookups between scrapes, links and stories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids


def hydrate(links: DataFrame, scrapes: DataFrame) -> DataFrame:
    """Scrapes of the linked stories, one row per link; links to nothing are dropped.

    An equi-join on the scrape's month and id; the month prunes the partitioned table.
    """
    stored = scrapes.withColumnsRenamed({"shard": "scrape_shard"})
    return (links.select("story_id", "scrape_shard", "scrape_id")
            .join(stored, ["scrape_shard", "scrape_id"])
            .withColumnRenamed("scrape_shard", "shard"))


def in_months_of(links: DataFrame, scrapes: DataFrame) -> DataFrame:
    """The scrapes of the months that the links point into: a list on the driver, one entry
    per month, so that only those partitions are read."""
    months = sorted(r["scrape_shard"] for r in links.select("scrape_shard").distinct().collect())
    return scrapes.where(F.col("shard").isin(months))


def fetch_scrape(scrapes: DataFrame, shard: int, scrape_id: str) -> DataFrame:
    return scrapes.where((F.col("shard") == shard) & (F.col("scrape_id") == scrape_id)).limit(1)


def find_story(stories: DataFrame, story_id: str) -> DataFrame:
    """Story by id. The id holds its month, which prunes to one partition."""
    shard = ids.decode_story_id(F.lit(story_id))["shard"]
    return stories.where((F.col("shard") == shard) & (F.col("story_id") == story_id))


def match_existing(new: DataFrame, existing: DataFrame, days: int = 30) -> DataFrame:
    """For each new collection, the existing story it belongs to, or nulls.

    ``new`` has (new_key, url_norm, date), ``existing`` (story_id, shard, url_norm, date).
    A match has the same url_norm, a date in ``[-days, +days)`` of the new one, and lies in
    the new one's month or the month before; the same month wins, then the earliest date.

    Both sides hold collections, not scrapes: stories of one URL lie at least a merge
    window apart, so a (url_norm, month) pair holds a bounded handful of rows and the
    equi-join on both cannot blow up.
    """
    span = F.make_dt_interval(F.lit(days))
    probe = new.select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("back"), _month(F.col("date")).alias("look")),
        F.struct(F.lit(1).alias("back"), (_month(F.col("date")) - 1).alias("look")),
    )).alias("_p")).select("*", "_p.back", "_p.look").drop("_p")
    found = existing.select(
        F.col("story_id").alias("match_id"), F.col("shard").alias("match_shard"),
        F.col("date").alias("match_date"), F.col("url_norm").alias("_norm"))
    hit = ((probe["url_norm"] == found["_norm"]) & (probe["look"] == found["match_shard"])
           & (found["match_date"] >= probe["date"] - span)
           & (found["match_date"] < probe["date"] + span))
    best = F.min(F.when(F.col("match_id").isNotNull(),
                        F.struct("back", "match_date", "match_id", "match_shard")))
    return (probe.join(found, hit, "left").groupBy(*new.columns).agg(best.alias("m"))
            .select(*new.columns, "m.match_id", "m.match_shard"))


def _month(ts):
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def found(new: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    return new.join(existing, on, "left_semi")


def unfound(new: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    return new.join(existing, on, "left_anti")


def hits_or_fallback(hits: DataFrame, fallback: DataFrame) -> DataFrame:
    """All hits; the fallback rows only when there is no hit at all."""
    any_hit = hits.limit(1).agg(F.count(F.lit(1))).scalar()
    return hits.unionByName(fallback.where(any_hit == 0))
