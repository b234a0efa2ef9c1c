"""Front page, hot set, pins, paging and sort orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import EngineConfig, TagConfig
from . import scoring, tagging


def newest_date(stories: DataFrame) -> Column:
    """Date of the newest story, as a scalar subquery: the engine's "now". Months never
    overlap, so a partitioned table is read in its newest month only."""
    newest = stories.where(F.col("shard") == stories.agg(F.max("shard")).scalar())
    return newest.agg(F.max("date")).scalar()


def front_page_candidates(stories: DataFrame, max_count: int,
                          stored: bool = False) -> DataFrame:
    """Newest ``2 * max_count`` stories of the three newest months, then the best
    ``max_count`` of them by stored score. Adds ``now``, the newest story's date.

    The first limit is a top-k over the whole input; everything after it sees at most
    ``2 * max_count`` rows, so its one-partition windows are small. ``stored=True`` also
    bounds the scan by a scalar subquery on the month, which prunes a partitioned table
    to three partitions; for a computed input that would evaluate it twice.
    """
    if stored:
        stories = stories.where(F.col("shard") >= stories.agg(F.max("shard")).scalar() - 2)
    recent = stories.orderBy(F.desc("shard"), F.desc("date"), "story_id").limit(2 * max_count)
    everything = Window.partitionBy()
    return (recent
            .withColumn("now", F.max("date").over(everything))
            .withColumn("_newest", F.max("shard").over(everything))
            .where(F.col("shard") >= F.col("_newest") - 2).drop("_newest")
            .orderBy(F.desc("score"), F.desc("date"), "story_id").limit(max_count))


def hot_set(candidates: DataFrame, cfg: EngineConfig = EngineConfig(),
            pinned_url: str | None = None) -> DataFrame:
    """Candidates ordered by aged score. ``position`` counts from 0; at most one pinned
    story leads, and other stories with its URL are dropped.

    The input is bounded by the hot-set size, so the one-partition window is small.
    """
    now = F.col("now")
    aged = candidates.withColumn(
        "aged_score",
        F.col("score") + scoring.age_score(scoring.age_hours(now, F.col("date")), cfg.score))
    key = (F.col("aged_score") * -1000.0).cast("int")
    tie = [F.desc("score"), F.desc("date"), F.asc("story_id")]
    rows = aged.withColumn("pinned", F.lit(False))
    if pinned_url is not None:
        copies = Window.partitionBy("pinned").orderBy(*tie)
        rows = (aged.withColumn("pinned", F.col("url") == F.lit(pinned_url))
                .withColumn("_copy", F.row_number().over(copies))
                .where(~F.col("pinned") | (F.col("_copy") == 1)).drop("_copy"))
    order = Window.orderBy(F.desc("pinned"), key, *tie)
    return rows.withColumn("position", F.row_number().over(order) - 1)


def pin_is_live(post_date: Column, now: Column, days: int = 2) -> Column:
    return post_date + F.make_dt_interval(F.lit(days)) > now


def live_pin(posts: DataFrame, now: Column, days: int = 2) -> DataFrame:
    """URL of the newest post while its pin is live, else no row."""
    newest = posts.orderBy(F.desc("date"), F.asc("id")).limit(1)
    return newest.where(pin_is_live(F.col("date"), now, days)).select("url")


def top_tags(hot: DataFrame, tags: TagConfig, limit: int = 50) -> DataFrame:
    """Host and tag counts of the hot set; self posts and pinned stories do not count."""
    counted = (hot.where(~F.col("pinned") & ~F.col("self_post"))
               .select(F.explode(F.concat(F.array("host"), "tags")).alias("tag"))
               .groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
               .orderBy(F.desc("n"), "tag").limit(limit))
    return counted.select(tagging.display_tag(F.col("tag"), tags).alias("tag"), "n")


def display_tags(cfg: TagConfig) -> Column:
    """Host first when it has a dot, then the shown form of each tag."""
    shown = F.transform("tags", lambda t: tagging.display_tag(t, cfg))
    return F.when(F.col("host").contains("."), F.concat(F.array("host"), shown)).otherwise(shown)


def render(stories: DataFrame, cfg: TagConfig, order: str = "position") -> DataFrame:
    return stories.select(
        F.col(order).alias("order"), F.col("story_id").alias("id"), "url",
        F.col("host").alias("domain"), "title", "date", "score",
        display_tags(cfg).alias("tags"), "sources")


def with_posts(stories: DataFrame, posts: DataFrame, own_host: str) -> DataFrame:
    """Own-site stories survive only when they match a known post, whose tags they gain."""
    known = posts.select(F.col("url").alias("_post_url"), F.col("tags").alias("_post_tags"),
                         F.col("html").alias("html"))
    joined = stories.join(known, stories["url"] == known["_post_url"], "left")
    keep = (F.col("host") != own_host) | F.col("_post_url").isNotNull()
    gained = F.array_union("tags", F.coalesce("_post_tags", F.array().cast("array<string>")))
    return (joined.where(keep)
            .withColumn("tags", F.when(F.col("host") == own_host, gained).otherwise(F.col("tags")))
            .drop("_post_url", "_post_tags"))


def page(ordered: DataFrame, order: list, offset: int = 0, count: int = 30,
         cap: int | None = None) -> DataFrame:
    """Rows ``offset .. offset+count``, of the first ``cap`` rows if given, renumbered from 0."""
    rows = ordered.orderBy(*order)
    if cap is not None:
        rows = rows.limit(cap)
    rows = rows.orderBy(*order).offset(offset).limit(max(count, 1))
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)


SORT_KEYS = {
    "date": [F.desc, "date"], "score": [F.desc, "score"],
    "domain": [F.asc, "host"], "title": [F.asc, "title"], "order": [F.asc, "position"],
}


def sorted_by(stories: DataFrame, key: str) -> DataFrame:
    direction, column = SORT_KEYS[key]
    return stories.orderBy(direction(column), "story_id")


def compare_score_order() -> list[Column]:
    """Ascending score, NaN scores by date."""
    return [F.nanvl("score", F.lit(None).cast("double")).asc_nulls_first(), F.col("date").asc()]


def top_k(rows: DataFrame, score: str, seq: str, k: int) -> DataFrame:
    """Best ``k`` by score; a later row must be strictly better to displace one."""
    return rows.orderBy(F.desc(score), F.asc(seq)).limit(k)
