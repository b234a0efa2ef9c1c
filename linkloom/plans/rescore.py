"""Recompute stories from their raw scrapes: score tuning and re-indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import cluster, joins
from . import stories as st


def recompute(links: DataFrame, scrapes: DataFrame,
              cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Evaluate the stories of a link table again; adds ``old_id``, the id in the links."""
    raw = joins.hydrate(links, scrapes).withColumnRenamed("story_id", "old_id")
    rolled = cluster.roll_up(st.scored_core(raw, cfg), ["url_norm", "old_id"])
    return st.finish(rolled, ["url_norm", "old_id"], cfg)


def score_tuner(front: DataFrame, links: DataFrame, scrapes: DataFrame,
                cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Front-page stories scored with ``cfg``, next to their stored score, best first.

    ``front`` is bounded by the hot-set size, so its link lookup is a broadcast semi join
    whose months prune the links, and the final ranking window is small.
    """
    wanted = front.select("shard", "story_id", F.col("score").alias("stored_score"))
    chosen = links.join(F.broadcast(wanted.select("shard", "story_id")), ["shard", "story_id"], "left_semi")
    fresh = recompute(chosen, scrapes, cfg)
    rows = fresh.join(wanted.select(F.col("story_id").alias("old_id"), "stored_score"), "old_id")
    place = Window.orderBy(F.desc("score"), F.asc("story_id"))
    return rows.withColumn("place", F.row_number().over(place))
