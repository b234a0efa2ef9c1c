"""Rate classification as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import RateLimit
from ..operators.rates import RateState

_STATE = "v0 bigint, v1 bigint, v2 bigint, v3 bigint, v4 bigint, v5 bigint"
OUTPUT = "key string, second bigint, none bigint, soft bigint, hard bigint"


class _Classifier(StatefulProcessor):
    """Six counters per key, gone by a timer once both buckets are over."""

    def __init__(self, limit: RateLimit):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("buckets", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        # A row per second of a key: as many as time has passed, however many events there were.
        found = sorted((int(s), int(n)) for frame in rows for s, n in zip(frame["second"], frame["n"]))
        state = RateState(self.limit, self.state.get() if self.state.exists() else None)
        out = [(str(key[0]), s, *state.add(s, n)) for s, n in found]
        self.state.update(tuple(state.values))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state.until() * 1000)
        yield pd.DataFrame(out, columns=["key", "second", "none", "soft", "hard"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield pd.DataFrame([], columns=["key", "second", "none", "soft", "hard"])

    def close(self) -> None:
        pass


def classify_stream(events: DataFrame, limit: RateLimit, late: str = "10 seconds") -> DataFrame:
    """Stream of (key, ts) to (key, second, none, soft, hard): how many of a second's events
    have which level. ``rates.levels_of`` gives single events their level.

    Events are counted per (key, second) first, combined before the shuffle, so a hot key is a
    row per second. A second is final ``late`` after it. Seconds of a key then meet its
    counters in order. Needs the RocksDB state store provider.
    """
    seconds = (events.withWatermark("ts", late)
               .groupBy(F.window("ts", "1 second"), F.col("key").cast("string").alias("key"))
               .agg(F.count(F.lit(1)).alias("n"))
               .select("key", F.window_time("window").alias("at"), F.unix_seconds("window.start").alias("second"), "n"))
    return seconds.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Classifier(limit), outputStructType=OUTPUT,
        outputMode="append", timeMode="eventTime")
