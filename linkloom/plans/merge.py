"""Merging a batch of scrapes into existing stories."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import ids
from ..functions.months import month_of
from ..operators import cluster, core, joins, scoring
from . import rescore
from . import stories as st


@dataclass
class MergeResult:
    """``changed`` are new versions of stories, ``gone`` the ids they replace, ``links``
    the link rows of the changed stories, ``results`` one row per collection."""

    changed: DataFrame
    gone: DataFrame
    links: DataFrame
    results: DataFrame


def collections_of(batch: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Batch scrapes as scored core rows with their collection key ``new_key``."""
    rows = cluster.assign_clusters(st.scored_core(batch, cfg), cfg)
    return rows.withColumn("new_key", F.concat_ws("#", F.col("anchor").cast("string"), "url_norm"))


def _unstaged(df: DataFrame, _name: str) -> DataFrame:
    return df


def _pruned(scrapes: DataFrame, links: DataFrame, stage) -> DataFrame:
    """Only the months the links point into, if the links are at hand rather than a plan."""
    return scrapes if stage is _unstaged else joins.in_months_of(links, scrapes)


def merge_batch(batch: DataFrame, stories: DataFrame, links: DataFrame, scrapes: DataFrame,
                cfg: EngineConfig = EngineConfig(),
                stage: Callable[[DataFrame, str], DataFrame] = _unstaged) -> MergeResult:
    """Cluster the batch, find each collection's story, recompute what is touched.

    ``scrapes`` is the raw store with or without the batch in it. Only stories that a
    collection matches are hydrated; the rest of the tables is filtered by semi join.
    Stories are replaced under the id they were found by, because an earlier scrape
    changes a story's date and with it its id.

    ``stage`` may write an intermediate table to shared storage and read it back, so the
    outputs do not each repeat the work before it.
    """
    rows = stage(collections_of(batch, cfg), "collections")
    heads = rows.groupBy("new_key", "url_norm").agg(F.min("date").alias("date"))
    matched = stage(joins.match_existing(heads, stories, cfg.merge_days), "matched")
    # All collections that found one story merge into it; a new story keeps its own key.
    target = matched.select("new_key", "match_id",
                            F.coalesce("match_id", "new_key").alias("group_key"))
    gone = matched.where(F.col("match_id").isNotNull()).select(
        F.col("match_shard").alias("shard"), F.col("match_id").alias("story_id")).distinct()

    incoming = (rows.join(target.select("new_key", "group_key"), "new_key")
                .drop("new_key", "anchor"))
    old_links = stage(links.join(gone, ["shard", "story_id"], "left_semi"), "old_links")
    stored = (st.scored_core(joins.hydrate(old_links, _pruned(scrapes, old_links, stage)), cfg)
              .withColumnRenamed("story_id", "group_key"))
    columns = [c for c in incoming.columns if c in stored.columns and c != "seq"]
    arrivals = (stored.select(*columns).withColumn("seq", F.lit(0))
                .unionByName(incoming.select(*columns).withColumn("seq", F.lit(1))))
    order = F.struct("seq", "date", F.xxhash64(F.to_json(F.struct("url", "raw_title"))))
    merged = cluster.dedup(arrivals.withColumn("seq", order), ["group_key", "scrape_id"],
                           cfg.merge_policy).drop("seq")
    merged = stage(merged, "merged")
    if cfg.merge_policy == "max":
        merged = scoring.with_single_score(merged, cfg.score)
    rolled = cluster.roll_up(merged, ["url_norm", "group_key"])
    changed = st.finish(rolled, ["url_norm", "group_key"], cfg)
    link_rows = st.links_of(merged.select("url_norm", "group_key", "shard", "date", "scrape_id"),
                            ["url_norm", "group_key"])
    results = matched.select("new_key", F.when(F.col("match_id").isNotNull(), "merged")
                             .otherwise("new").alias("result"))
    return MergeResult(changed.drop("group_key"), gone, link_rows, results)


def reindex(wanted: DataFrame, stories: DataFrame, links: DataFrame, scrapes: DataFrame,
            cfg: EngineConfig = EngineConfig(),
            stage: Callable[[DataFrame, str], DataFrame] = _unstaged) -> MergeResult:
    """Recompute the given story ids with the current configuration. The ids' months, which
    they hold, narrow every join and with it the partitions that are read."""
    wanted = wanted.select(ids.decode_story_id(F.col("story_id"))["shard"].alias("shard"), "story_id").distinct()
    key = ["shard", "story_id"]
    present = wanted.join(stories.select(*key), key, "left_semi")
    chosen = stage(links.join(present, key, "left_semi"), "chosen")
    changed = rescore.recompute(chosen, _pruned(scrapes, chosen, stage), cfg)
    renamed = changed.select(F.col("old_id"), F.col("story_id").alias("_new"),
                             F.col("shard").alias("_shard"))
    link_rows = (chosen.withColumnRenamed("story_id", "old_id").join(renamed, "old_id")
                 .select(F.col("_shard").alias("shard"), F.col("_new").alias("story_id"),
                         "scrape_shard", "scrape_id"))
    results = (wanted.join(stories.select(*key, F.lit(1).alias("hit")), key, "left")
               .select("story_id", F.when(F.col("hit") == 1, "merged").otherwise("not_found")
                       .alias("result")))
    return MergeResult(changed.drop("old_id"), present, link_rows, results)
