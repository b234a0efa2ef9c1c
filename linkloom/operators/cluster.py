"""Grouping scrapes into stories by canonical URL and month neighbourhood.

A scrape joins a story when its month is at most ``cluster_months`` after the month of the
story's earliest scrape; otherwise it opens a new story. The opening months ("anchors") of
one URL depend only on the distinct months in which it was seen, never on the number of
sightings. So every plan here first reduces to one row per (url_norm, month), with map-side
combining, and only then looks at a URL as a whole. A URL that holds a third of all rows
still contributes at most one row per month to that step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import SOURCES, TITLE_PRIORITY, EngineConfig

MERGED_MAXIMA = ("points", "comments", "score", "upvotes", "downvotes", "upvote_ratio",
                 "position")


def anchor_months(months: Column, reach: int = 2) -> Column:
    """Anchors of an array of distinct months: a fold over the sorted array."""
    start = F.array().cast("array<int>")

    def step(acc: Column, m: Column) -> Column:
        opens = (F.size(acc) == 0) | (m - F.element_at(acc, -1) > reach)
        return F.when(opens, F.array_append(acc, m)).otherwise(acc)

    return F.aggregate(F.sort_array(months), start, step)


def _with_anchor(per_month: DataFrame, reach: int) -> DataFrame:
    """Add ``anchor`` to rows that are unique per (url_norm, shard)."""
    by_norm = Window.partitionBy("url_norm")
    anchors = anchor_months(F.collect_list("shard").over(by_norm), reach)
    return (per_month
            .withColumn("_anchors", anchors)
            .withColumn("anchor", F.array_max(
                F.filter("_anchors", lambda a: a <= F.col("shard"))))
            .drop("_anchors"))


def anchored_months(core: DataFrame, figures: list[Column],
                    cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(url_norm, shard, anchor) with figures of each month of each URL."""
    per_month = core.groupBy("url_norm", "shard").agg(*figures)
    return _with_anchor(per_month, cfg.cluster_months)


def month_anchors(core: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(url_norm, shard, anchor): the story each month of each URL belongs to."""
    return _with_anchor(core.select("url_norm", "shard").distinct(), cfg.cluster_months)


def assign_clusters(core: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add ``anchor`` to every scrape; (url_norm, anchor) names its story.

    The lookup side has one row per (url_norm, month). A hot month of a hot URL makes a
    skewed join partition, which adaptive execution splits on the scrape side.
    """
    return core.join(month_anchors(core, cfg), ["url_norm", "shard"])


def dedup(rows: DataFrame, keys: list[str], policy: str, seq: str = "seq") -> DataFrame:
    """One row per key. ``first``/``last`` by arrival ``seq``; ``max`` also takes the
    largest counters of all copies. Aggregates combine before the shuffle, so a group of
    copies of any size leaves each map task as one row."""
    others = [c for c in rows.columns if c not in keys]
    if policy not in ("first", "last", "max"):
        raise ValueError(f"unknown policy {policy!r}")
    pick = F.min_by if policy == "first" else F.max_by
    picked = rows.groupBy(*keys).agg(
        pick(F.struct(*others), F.col(seq)).alias("_row"),
        *([F.max(c).alias(f"_max_{c}") for c in MERGED_MAXIMA if c in others]
          if policy == "max" else []))
    columns = [F.col(k) for k in keys]
    for c in others:
        best = F.col(f"_row.{c}")
        if policy == "max" and c in MERGED_MAXIMA:
            best = _merged_max(c, best)
        columns.append(best.alias(c))
    return picked.select(*columns).select(*rows.columns)


def _merged_max(column: str, kept: Column) -> Column:
    """Which counters take the maximum depends on the source; the rest keep their row."""
    source = F.col("_row.source")
    by_source = {
        "points": ["hacker_news"],
        "comments": ["hacker_news", "reddit", "lobsters", "slashdot"],
        "score": ["reddit", "lobsters"],
        "upvotes": ["reddit"], "downvotes": ["reddit"], "upvote_ratio": ["reddit"],
        "position": ["reddit"],
    }[column]
    return F.when(source.isin(*by_source), F.col(f"_max_{column}")).otherwise(kept)


def _priority() -> Column:
    out = F.lit(99)
    for name, value in TITLE_PRIORITY.items():
        out = F.when(F.col("source") == name, F.lit(value)).otherwise(out)
    return out


def _facts(core: DataFrame, extra: list[str]) -> DataFrame:
    """Scrape columns in the shape the story aggregates read, one row per source tag.

    Exploding the tags lets one aggregate collect distinct tags; the other aggregates are
    minima and maxima, which repeats do not change, and the count looks at the first
    repeat only.
    """
    keys = ["url_norm", *extra]
    pick = F.struct(F.col("single_score"), F.col("scrape_id"))
    return core.select(
        *keys, F.posexplode_outer("core_tags").alias("_pos", "_tag"),
        "date", "source",
        F.struct(_priority().alias("prio"), "scrape_id", "title").alias("_title"),
        F.struct("date", "scrape_id", "url", "host").alias("_url"),
        pick.alias("_pick"), "self_post",
        F.col("scrape_id")).withColumn("_one", (F.coalesce("_pos", F.lit(0)) == 0).cast("bigint"))


_BEST = [f"best_{s}" for s in SOURCES]


def _first_level() -> list[Column]:
    return [
        F.sum("_one").alias("n_scrapes"),
        F.min("date").alias("date"),
        F.min("_title").alias("_title"),
        F.min("_url").alias("_url"),
        F.max("self_post").alias("self_post"),
        F.collect_set("_tag").alias("source_tags"),
        *[F.max(F.when(F.col("source") == s, F.col("_pick"))).alias(f"best_{s}")
          for s in SOURCES],
    ]


def _second_level() -> list[Column]:
    return [
        F.sum("n_scrapes").alias("n_scrapes"),
        F.min("date").alias("date"),
        F.min("_title").alias("_title"),
        F.min("_url").alias("_url"),
        F.max("self_post").alias("self_post"),
        F.array_distinct(F.flatten(F.collect_list("source_tags"))).alias("source_tags"),
        *[F.max(b).alias(b) for b in _BEST],
    ]


def _named(rolled: DataFrame, keys: list[str]) -> DataFrame:
    return rolled.select(
        *keys, "date", F.col("_title.title").alias("title"), F.col("_url.url").alias("url"),
        F.col("_url.host").alias("host"), "n_scrapes", "self_post",
        F.sort_array("source_tags").alias("source_tags"), *_BEST)


def roll_up(core: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group of already grouped, id-unique scrapes. ``keys`` includes
    url_norm. A single aggregate; a hot group reaches the reducer as one row per map task.
    """
    extra = [k for k in keys if k != "url_norm"]
    return _named(_facts(core, extra).groupBy(*keys).agg(*_first_level()), keys)


def cluster_and_roll_up(core: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """C1 and the story aggregates in one pass, for scrapes with unique ids.

    Level one reduces to (url_norm, month) rows before the first shuffle; level two finds
    the anchors among those rows and merges them. No scrape-level join.
    """
    per_month = _facts(core, ["shard"]).groupBy("url_norm", "shard").agg(*_first_level())
    anchored = _with_anchor(per_month, cfg.cluster_months)
    rolled = anchored.groupBy("url_norm", "anchor").agg(*_second_level())
    return _named(rolled, ["url_norm", "anchor"])
