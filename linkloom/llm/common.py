"""What the operators share: checkpoints in the shared folder, words, balanced salts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the six ASCII characters that separate words. ``bytes.split()`` and
# ``bytes.strip()`` use just these.
WHITESPACE = b" \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a session without that setting (a local test) gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None)
                            or tempfile.mkdtemp(prefix="shared-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder; a lost executor loses nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``settle``, but compressed and readable column by column."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table of this many narrow rows at most is broadcast (some 20 MB); a larger one is shuffled.
BROADCAST_ROWS = 200_000


def sized(small: DataFrame, rows: int | None = None) -> DataFrame:
    """``small`` marked for a broadcast join if it is small, counted first if need be.

    Pass a settled table. A larger one goes into an ordinary join, whose skew adaptive
    execution splits.
    """
    return F.broadcast(small) if (small.count() if rows is None else rows) <= BROADCAST_ROWS else small


#: Bytes that a Python worker gets at once, but for a single longer row.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds at once: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")


def let_go() -> None:
    """Give freed memory back to the system, from Arrow's pool and from the C library's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]):
    """``run`` for mapInPandas, after which the Python worker lets go of what the task held: workers
    outlive their tasks, and those that wait count as their executor's memory, too."""
    def leaner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            let_go()
    return leaner


def local_table(spark: SparkSession, rows: list[tuple], columns: dict[str, pa.DataType]) -> DataFrame:
    """A few rows of the driver as a table. Made from Arrow, it is a plain local relation; from a list
    it would need Python workers on the executors, and a Python daemon besides that of the functions."""
    table = pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(columns.items())})
    return spark.createDataFrame(table)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_row(df: DataFrame) -> Column:
    """The input row as one value, so that no column of it clashes with ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def with_row(df: DataFrame, row: str, names: list[str], new: list[Column]) -> DataFrame:
    """The packed row's columns again, then the new ones; a new name replaces an old column."""
    lower = {n.lower() for n in names}
    kept = [F.col(f"`{row}`.`{f.name}`").alias(f.name) for f in df.schema[row].dataType.fields
            if f.name.lower() not in lower]
    return df.select(*kept, *[c.alias(n) for n, c in zip(names, new)])


def salts(rows: Column, total: Column, parts: int) -> Column:
    """Into how many pieces a group of ``rows`` is cut, so that no piece holds more than a
    quarter of what a partition holds on average."""
    return F.greatest(F.lit(1), F.ceil(rows * 4 * parts / F.greatest(total, F.lit(1)))).cast("long")
