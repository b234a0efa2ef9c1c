"""Session helpers: the settings the operators assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Needed for right results everywhere, or plain good practice at any size. Partition
# counts and memory are the cluster's business and are left alone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Story aggregates hold about a kilobyte per group; the default gives up hashing after
    # 128 groups and sorts every row instead.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
}

# Static settings, for whoever builds the session: column expressions otherwise record
# their Python call site, which makes building a plan several times slower.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder all executors share (``spark.checkpoint.dir``); a session
    without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="linkloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Compute the columns of ``df`` once per row, here.

    The optimizer moves a filter on a computed column below the projection that computes
    it, and so computes it twice. It does not look through a generator.
    """
    row = F.explode(F.array(F.struct(*[F.col(c) for c in df.columns])))
    return df.select(row.alias("_row")).select("_row.*")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared folder and read again, so that what is not
    deterministic in it (places, partitions) is fixed and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
