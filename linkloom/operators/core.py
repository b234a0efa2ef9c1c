"""Core projection: one cleaned row per scrape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig, SourceConfig
from ..functions import ids, text, urls
from ..functions.months import month_of

RANKED_SOURCES = ("hacker_news", "reddit", "lobsters")


def hacker_news_title_tags(title: Column) -> Column:
    marks = F.array(
        F.when(title.startswith("Show HN"), F.lit("show")),
        F.when(title.startswith("Ask HN"), F.lit("ask")),
        F.when(title.endswith("[pdf]"), F.lit("pdf")),
        F.when(title.endswith("[video]"), F.lit("video")))
    return F.array_compact(marks)


def reddit_tags(subsource: Column, flair: Column, cfg: SourceConfig) -> Column:
    """Flair and subreddit, each when the subreddit's settings say so.

    An empty flair is dropped. The settings are configuration, so they are literals.
    """
    subs = cfg.reddit.subreddits
    flair_subs = [s for s, o in subs.items() if o.get("flair_is_tag")]
    tag_subs = [s for s, o in subs.items() if o.get("is_tag")]
    use_flair = subsource.isin(*flair_subs) & (flair != "") & ~flair.contains(" ")
    return F.array_compact(F.array(
        F.when(use_flair, F.lower(flair)),
        F.when(subsource.isin(*tag_subs), subsource)))


def with_core_title(rows: DataFrame) -> DataFrame:
    """Add ``title``: reddit titles lose edge tags and are shortened. Two steps, so the
    bare title is computed once."""
    bare = F.when(F.col("source") == "reddit", text.remove_edge_tags(F.col("raw_title")))
    return (rows.withColumn("_bare", bare)
            .withColumn("title", F.coalesce(text.trim_title(F.col("_bare")), "raw_title"))
            .drop("_bare"))


def core_tags(cfg: SourceConfig) -> Column:
    source, tags = F.col("source"), F.col("tags")
    allowed = F.array(*[F.lit(t) for t in cfg.slashdot_tags])
    denied = F.array(*[F.lit(t) for t in cfg.lobsters_denied_tags])
    empty = F.array().cast("array<string>")
    picked = (F.when(source == "hacker_news", hacker_news_title_tags(F.col("raw_title")))
              .when(source == "reddit", reddit_tags(F.col("subsource"), F.col("flair"), cfg))
              .when(source == "slashdot", F.array_intersect(tags, allowed))
              .when(source == "lobsters", F.array_except(tags, denied))
              .otherwise(tags))
    return F.coalesce(picked, empty)


def core_rows(scrapes: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add host, url_norm, title, core_tags and zero-based rank; drop unusable URLs.

    One narrow projection, so column pruning and filters pass through it.
    """
    source = F.col("source")
    rank = F.when(source.isin(*RANKED_SOURCES) & (F.col("position") > 0), F.col("position") - 1)
    usable = scrapes.where(urls.has_host(F.col("url")))
    keyed = urls.with_url_keys(usable.withColumn("shard", month_of(F.col("date"))))
    # Never null here. Saying so keeps joins and groupings on it from adding a null filter,
    # which would compute the whole form a second time below the projection.
    keyed = keyed.withColumn("url_norm", F.coalesce("url_norm", F.lit("")))
    return (with_core_title(keyed)
            .withColumn("core_tags", core_tags(cfg.sources))
            .withColumn("rank", rank)
            .withColumn("self_post",
                        ids.is_self_post(source, F.col("id"), F.col("host"), F.col("url"))))
