"""Upserts on plain partitioned tables, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import dedup


def upsert_scrapes(old: DataFrame, batch: DataFrame, policy: str = "last",
                   seq: str = "seq") -> DataFrame:
    """Stored rows with the batch on top, one row per (shard, scrape_id).

    ``seq`` orders arrivals inside the batch; stored rows come before all of them. The
    caller passes only the months the batch touches.
    """
    ranked = (old.withColumn("_batch", F.lit(0)).withColumn(seq, F.lit(0).cast("bigint"))
              .unionByName(batch.withColumn("_batch", F.lit(1))))
    ordered = ranked.withColumn("_seq", F.struct("_batch", F.col(seq)))
    return dedup(ordered, ["shard", "scrape_id"], policy, "_seq").drop("_batch", "_seq")


def unique_scrapes(rows: DataFrame, policy: str = "last", seq: str = "seq") -> DataFrame:
    """One row per scrape id over all months, by the same rule as an upsert."""
    return dedup(rows.withColumn("_seq", F.struct(F.col(seq), "date")), ["scrape_id"], policy, "_seq").drop("_seq", seq)


def replace_rows(old: DataFrame, gone: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Delete the rows whose key is in ``gone``, then add ``new``."""
    key = [key] if isinstance(key, str) else key
    return old.join(gone.select(*key).distinct(), key, "left_anti").unionByName(new)
