"""Streams over payload files and page events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.rates import page_windows
from ..plans.store import StoryStore
from ..schema import PAGE_EVENTS, PAYLOADS
from ..sources.payloads import scrape_payloads


def payload_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return (spark.readStream.schema(PAYLOADS).option("maxFilesPerTrigger", files_per_batch)
            .json(folder))


def ingest_stream(payloads: DataFrame, store: StoryStore, checkpoint: str,
                  every: str | None = None, refresh: bool = True) -> StreamingQuery:
    """Parse each micro-batch and merge it into the store.

    A replayed batch changes nothing: the raw upsert and the merge are keyed by scrape id.
    Late scrapes need no watermark, because the merge looks back a bounded month.
    ``every`` is a processing-time interval; without it the stream drains and stops. Warnings
    go to the store's ``warnings`` table, one folder per batch, so a replay replaces them.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        parsed = scrape_payloads(batch, store.cfg)
        store.note_warnings(parsed.warnings, batch_id)
        store.ingest(parsed.scrapes, f"batch-{batch_id}")
        if refresh:
            store.refresh_hot_set()

    writer = payloads.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PAGE_EVENTS).json(folder)


def page_window_stream(events: DataFrame, path: str, checkpoint: str, minutes: int = 60,
                       late: str = "10 minutes") -> StreamingQuery:
    """Finished windows to Parquet, appended once the watermark has passed them."""
    return (page_windows(events, minutes, late).writeStream.outputMode("append")
            .format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
