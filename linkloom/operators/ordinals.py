"""Places of rows in a global order, without a window over one partition.

Rows are dealt by ranges of the order and sorted inside each partition; a row's place is the
number of rows in earlier partitions plus its own position. Only one row per partition and
group is summed up, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Runs of a group in a partition that are broadcast at most; more are joined by a shuffle.
BROADCAST_RUNS = 100_000


def with_place(rows: DataFrame, order: list[str], group: list[str] | None = None,
               name: str = "place") -> DataFrame:
    """``rows`` with the place (from 0) of each row in its group, by ``order`` (ascending, nulls
    first). Ties get different places; for a rerun to agree the order should be total, and
    columns that spread equal rows belong at its end."""
    group, spark = group or [], rows.sparkSession
    keys = [*group, *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = staged(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    runs = ranged.groupBy(part.alias("_part"), *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    if group:
        ahead = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
        runs = staged(runs.withColumn("_ahead", ahead), "runs")
        small = runs.count() <= BROADCAST_RUNS
    else:
        found, total = [], 0
        for r in sorted(runs.collect()):  # one row per partition
            found.append((r["_part"], r["_first"], total))
            total += r["_n"]
        runs, small = spark.createDataFrame(found, "_part BIGINT, _first BIGINT, _ahead BIGINT"), True
    right = runs.select(F.col("_part").alias("_p"), "_first", "_ahead",
                        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    same: Column = F.shiftright(ranged["_at"], 33) == right["_p"]
    for i, g in enumerate(group):
        same = same & ranged[g].eqNullSafe(right[f"_g{i}"])
    placed = ranged.join(F.broadcast(right) if small else right, same)
    return placed.select(*rows.columns, (F.col("_ahead") + F.col("_at") - F.col("_first")).alias(name))
