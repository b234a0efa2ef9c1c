"""Late sightings as a stream: new collections wait for the stories they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH = ["match_id", "match_shard", "match_date"]


def match_stream(new: DataFrame, existing: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """Streams of ``new`` (new_key, url_norm, date) and ``existing`` (story_id, shard, url_norm,
    date), in any order, to one row per candidate; a new one without any gets nulls.

    The rule is that of ``joins.match_existing``: same canonical URL, a date within ``days``, in the
    new one's month or the month before. Both sides may be ``late``; then a row waits in the state only
    until no partner can come any more, and the unmatched are given out.
    """
    left = new.withWatermark("date", late)
    right = (existing.select(F.col("url_norm").alias("_norm"), F.col("story_id").alias("match_id"),
                             F.col("shard").alias("match_shard"), F.col("date").alias("match_date"))
             .withWatermark("match_date", late))
    month = F.year("date") * 12 + F.month("date") - 1
    span = F.expr(f"INTERVAL {int(days)} DAYS")
    hit = ((F.col("url_norm") == F.col("_norm"))
           & (F.col("match_date") >= F.col("date") - span) & (F.col("match_date") < F.col("date") + span)
           & F.col("match_shard").between(month - 1, month))
    return left.join(right, hit, "left_outer").drop("_norm")


def best_matches(candidates: DataFrame) -> DataFrame:
    """Of each new one's candidates the one that ``match_existing`` takes: the same month
    first, then the earliest date."""
    own = [c for c in candidates.columns if c not in MATCH]
    back = (F.year("date") * 12 + F.month("date") - 1 - F.col("match_shard")).alias("back")
    best = F.min(F.when(F.col("match_id").isNotNull(), F.struct(back, "match_date", "match_id", "match_shard")))
    return candidates.groupBy(*own).agg(best.alias("m")).select(*own, "m.match_id", "m.match_shard")
