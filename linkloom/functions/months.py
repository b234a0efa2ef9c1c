"""Month ordinals ("shards"): year * 12 + month - 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def month_from_parts(year: Column, month: Column) -> Column:
    return (year * 12 + month - 1).cast("int")


def month_label(shard: Column) -> Column:
    return F.format_string(
        "%04d-%02d", F.floor(shard / 12).cast("int"), (shard % 12 + 1).cast("int"))


def month_from_label(label: Column) -> Column:
    """Parse "YYYY-MM"; null when it is something else."""
    ok = label.rlike(r"^[0-9]{4}-[0-9]{2}$")
    return F.when(ok, month_from_parts(F.substring(label, 1, 4).cast("int"),
                                       F.substring(label, 6, 2).cast("int")))


def month_start(shard: Column) -> Column:
    return F.make_timestamp(
        F.floor(shard / 12).cast("int"), (shard % 12 + 1).cast("int"),
        F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def plus_months(shard: Column, n: int | Column) -> Column:
    return (shard + n).cast("int")
