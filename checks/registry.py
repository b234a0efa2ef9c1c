"""Where queries and twins are registered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.config import EngineConfig, TagConfig
from linkloom.session import configure
from linkloom.sources.derived import sightings

QUERIES: dict = {}
TWINS: dict[str, str] = {}

# A dictionary over words that occur in the driver tables, with every kind of entry.
DRIVER_TAGS = TagConfig({
    "gizmo(s)": {"implies": "gadget"},
    "ring": {"internal": "ringtag", "excludes": ["hot ring", "cold ring"]},
    "anvil": {"alts": ["plate", "old rod"]},
    "bolt(s)": {"excludes": ["red bolt"]},
    "widget": {"alt": "new(-)gear"},
    "gear": {},
    "steel": {"alts": ["small rod"]},
    "java": {}, "web": {},
    "go": {"internal": "golang"},
    "c++": {"internal": "cplusplus", "symbol": True},
    "***": {"internal": "stars", "symbol": True},
    "%%%": {"internal": "percent", "symbol": True, "implies": "maths"},
})
CFG = EngineConfig(tags=DRIVER_TAGS)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its twin when there is one."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            TWINS[name] = sql
        return fn
    return wrap


def scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir)


def secs(column: str | Column) -> Column:
    return F.unix_seconds(column)


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


def joined(column: str | Column) -> Column:
    return F.array_join(column, ",")
