"""From scrapes to stories, and the narrow story-to-scrape link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SOURCES, EngineConfig
from ..functions import ids
from ..functions.months import month_of
from ..operators import cluster, core, scoring, tagging


def scored_core(scrapes: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Core rows with their single-scrape score."""
    return scoring.with_single_score(core.core_rows(scrapes, cfg), cfg.score)


def finish(rolled: DataFrame, keys: list[str], cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Evaluate rolled-up groups: id, month, score and tags. One output row per group."""
    kept = [F.when(F.col(f"best_{s}").isNotNull(),
                   F.struct(F.lit(s).alias("key"), F.col(f"best_{s}.scrape_id").alias("value")))
            for s in SOURCES]
    extra = [k for k in keys if k != "url_norm"]
    return rolled.select(
        month_of(F.col("date")).alias("shard"),
        ids.story_id(F.col("date"), F.col("url_norm")).alias("story_id"),
        "url", "host", "url_norm", "title", "date",
        scoring.story_score(cfg.score).alias("score"),
        tagging.story_tags(F.col("title"), F.col("source_tags"), cfg.tags).alias("tags"),
        "n_scrapes",
        F.map_from_entries(F.array_compact(F.array(*kept))).alias("sources"),
        "self_post", *extra)


def build_stories(scrapes: DataFrame, cfg: EngineConfig = EngineConfig(),
                  unique_ids: bool = True) -> DataFrame:
    """All stories of a scrapes table.

    ``unique_ids`` says the table holds every scrape id once, as the store keeps it; the
    job then needs no scrape-level join. Otherwise copies are merged inside each story.
    """
    rows = scored_core(scrapes, cfg)
    if unique_ids:
        rolled = cluster.cluster_and_roll_up(rows, cfg)
    else:
        if "seq" not in rows.columns:
            # A stored table has no arrival order left; the later date stands.
            rows = rows.withColumn("seq", F.struct("date", F.xxhash64("url", "raw_title")))
        grouped = cluster.assign_clusters(rows, cfg)
        merged = cluster.dedup(grouped, ["url_norm", "anchor", "scrape_id"], cfg.merge_policy)
        if cfg.merge_policy == "max":
            merged = scoring.with_single_score(merged, cfg.score)
        rolled = cluster.roll_up(merged, ["url_norm", "anchor"])
    return finish(rolled, ["url_norm", "anchor"], cfg).drop("anchor")


def story_links(scrapes: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(shard, story_id, scrape_shard, scrape_id), one row per scrape, for unique ids.

    A link table instead of an array per story: a story seen a billion times stays a
    billion small rows on many tasks. A story's id needs only its earliest date, which is
    found on the (url_norm, month) rows, so the scrapes themselves are joined once.
    """
    rows = core.core_rows(scrapes, cfg).select("url_norm", "shard", "date", "scrape_id")
    first = F.min("_first").over(Window.partitionBy("url_norm", "anchor"))
    named = (cluster.anchored_months(rows, [F.min("date").alias("_first")], cfg)
             .withColumn("_first", first)
             .select("url_norm", "shard", month_of(F.col("_first")).alias("_story_shard"),
                     ids.story_id(F.col("_first"), F.col("url_norm")).alias("story_id")))
    return rows.join(named, ["url_norm", "shard"]).select(
        F.col("_story_shard").alias("shard"), "story_id",
        F.col("shard").alias("scrape_shard"), "scrape_id")


def links_of(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Link rows of groups that are already formed, such as merged stories."""
    first = grouped.groupBy(*keys).agg(F.min("date").alias("_first"))
    named = first.select(
        *keys, month_of(F.col("_first")).alias("_story_shard"),
        ids.story_id(F.col("_first"), F.col("url_norm")).alias("story_id"))
    return grouped.join(named, keys).select(
        F.col("_story_shard").alias("shard"), "story_id",
        F.col("shard").alias("scrape_shard"), "scrape_id").distinct()


def score_breakdown(grouped: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Every score term of every story, from scored scrapes with their ``anchor``."""
    keys = ["url_norm", "anchor"]
    whole = F.struct(*[c for c in grouped.columns])
    best = (grouped.groupBy(*keys, "source")
            .agg(F.max(F.struct("single_score", "scrape_id", whole.alias("row"))).alias("b"))
            .select("b.row.*"))
    rolled = cluster.roll_up(grouped, keys)
    named = rolled.withColumn("story_id", ids.story_id(F.col("date"), F.col("url_norm")))
    best = best.join(named.select(*keys, "story_id"), keys)
    return scoring.score_detail(best, named, named.agg(F.max("date")).scalar(), cfg)
