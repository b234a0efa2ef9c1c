"""Rate classification of an event stream, in batch form.

Two limits per key: a short and a long bucket, both aligned to the clock. An event sees the
accepted events of its own and the previous bucket. At twice the hard limit it is ``hard``
and not counted; at twice the soft limit it is ``soft``; else ``none``. The short limit
comes first, and an event it rejects never reaches the long one.

Within a bucket the outcome depends only on how many events came before, so events shrink
to one row per (key, short bucket) before anything is gathered by key. The chain over
buckets breaks wherever a key pauses for a whole long bucket; each unbroken run is one
group, and its size is bounded by elapsed time, not by the number of events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RateLimit

LEVELS = ("none", "soft", "hard")

_CHAIN_SCHEMA = ("key string, short_bucket bigint, n bigint, short_before bigint, "
                 "short_taken bigint, long_before bigint, long_room bigint")


def _buckets(events: DataFrame, limit: RateLimit) -> DataFrame:
    s = F.unix_seconds("ts")
    return events.withColumns({
        "short_bucket": F.floor(s / limit.short_seconds),
        "long_bucket": F.floor(s / limit.long_seconds)})


def bucket_states(events: DataFrame, limit: RateLimit) -> DataFrame:
    """Per (key, short bucket): events, accepted before, accepted here, and the same for
    the long bucket at the moment the short bucket opens. ``events`` has (key, ts)."""
    per = (_buckets(events.select(F.col("key").cast("string").alias("key"), "ts"), limit)
           .groupBy("key", "long_bucket", "short_bucket").agg(F.count(F.lit(1)).alias("n")))
    order = Window.partitionBy("key").orderBy("long_bucket", "short_bucket")
    gap = F.col("long_bucket") - F.lag("long_bucket").over(order)
    zero = F.lit(0).cast("bigint")
    near = F.lag("short_bucket").over(order) == F.col("short_bucket") - 1
    # Running totals; the events of the long bucket before lie in a range of bucket numbers.
    longs = Window.partitionBy("key").orderBy("long_bucket")
    runs = per.withColumns({
        "run": F.sum(F.coalesce((gap > 1).cast("int"), F.lit(0))).over(order),
        "_short_before": F.when(near, F.lag("n").over(order)).otherwise(zero),
        "_long_prev": F.coalesce(F.sum("n").over(longs.rangeBetween(-1, -1)), zero),
        "_long_here": F.sum("n").over(longs.rangeBetween(0, 0)),
        "_long_seen": F.sum("n").over(
            Window.partitionBy("key", "long_bucket").orderBy("short_bucket")) - F.col("n")})
    hard, long_hard = 2 * limit.short_hard, 2 * limit.long_hard
    over = ((F.col("_short_before") + F.col("n") > hard)
            | (F.col("_long_prev") + F.col("_long_here") > long_hard))
    runs = runs.withColumn("_over", F.max(over).over(Window.partitionBy("key", "run")))
    before = F.col("_long_prev") + F.col("_long_seen")
    calm = runs.where(~F.col("_over")).select(
        "key", "short_bucket", "n", F.col("_short_before").alias("short_before"),
        F.col("n").alias("short_taken"), before.alias("long_before"),
        (long_hard - before).alias("long_room"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        last_short = last_long = -2
        short_now = long_prev = long_now = 0
        for batch in batches:
            rows = []
            for key, long_b, short_b, n in zip(batch["key"], batch["long_bucket"].tolist(),
                                               batch["short_bucket"].tolist(), batch["n"].tolist()):
                if key != at:
                    at, last_short, last_long = key, -2, -2
                    short_now = long_prev = long_now = 0
                short_prev = short_now if short_b == last_short + 1 else 0
                if long_b != last_long:
                    long_prev = long_now if long_b == last_long + 1 else 0
                    long_now = 0
                taken = min(n, max(0, hard - short_prev))
                room = max(0, long_hard - long_prev - long_now)
                rows.append((key, short_b, n, short_prev, taken, long_prev + long_now, room))
                short_now = taken
                long_now += min(taken, room)
                last_short, last_long = short_b, long_b
            yield pd.DataFrame(rows, columns=["key", "short_bucket", "n", "short_before",
                                              "short_taken", "long_before", "long_room"])

    # Keys meet in one task in order; six counters are all that is held, whatever the length.
    walked = (runs.where("_over").select("key", "long_bucket", "short_bucket", "n")
              .repartition("key").sortWithinPartitions("key", "short_bucket")
              .mapInPandas(walk, _CHAIN_SCHEMA))
    return calm.unionByName(walked)


def _clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def rate_summary(events: DataFrame, limit: RateLimit) -> DataFrame:
    """(key, bucket_start, none, soft, hard): outcome counts per short bucket."""
    s = bucket_states(events, limit)
    zero = F.lit(0).cast("bigint")
    passed = F.least("short_taken", "long_room")
    # Events below both soft limits come first, so their number is a minimum.
    calm = _clamp(F.least(2 * limit.short_soft - F.col("short_before"),
                          2 * limit.long_soft - F.col("long_before")), zero, passed)
    return s.select(
        "key", (F.col("short_bucket") * limit.short_seconds).alias("bucket_start"),
        calm.alias("none"), (passed - calm).alias("soft"), (F.col("n") - passed).alias("hard"))


def classify_events(events: DataFrame, limit: RateLimit) -> DataFrame:
    """Every event with its ``level``. ``events`` has (key, ts, event_id, ...).

    The rank inside a (key, short bucket) comes in two steps, since an attack fills one bucket:
    counts per second are summed up over the bucket, whose seconds are few, and events are
    numbered inside their second.
    """
    states = bucket_states(events, limit)
    numbered = (_buckets(events.withColumn("key", F.col("key").cast("string")), limit)
                .withColumn("_second", F.unix_seconds("ts")))
    seconds = numbered.groupBy("key", "short_bucket", "_second").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("key", "short_bucket").orderBy("_second"))
    seconds = (seconds.withColumn("_before", upto - F.col("_n")).join(states, ["key", "short_bucket"])
               .select("key", "_second", "_before", "short_before", "long_before", "short_taken", "long_room"))
    place = F.row_number().over(Window.partitionBy("key", "_second").orderBy("ts", "event_id"))
    rows = numbered.withColumn("_place", place).join(seconds, ["key", "_second"])
    rank = F.col("_before") + F.col("_place") - 1
    rejected = (rank >= F.col("short_taken")) | (rank >= F.col("long_room"))
    warned = ((F.col("short_before") + rank >= 2 * limit.short_soft)
              | (F.col("long_before") + rank >= 2 * limit.long_soft))
    level = F.when(rejected, "hard").when(warned, "soft").otherwise("none")
    return rows.select(*events.columns, level.alias("level"))


def classify_requests(requests: DataFrame, ip: RateLimit, bot: RateLimit) -> DataFrame:
    """Requests (ip, agent, is_bot, ts, event_id) through the ip limits and then, for bots
    that pass, the agent limits; the worse outcome counts."""
    by_ip = classify_events(requests.withColumn("key", F.col("ip")), ip)
    bots = by_ip.where((F.col("level") != "hard") & F.col("is_bot"))
    by_agent = classify_events(
        bots.withColumn("key", F.col("agent")).select("key", "ts", "event_id"), bot)
    joined = by_ip.join(by_agent.select("event_id", F.col("level").alias("_bot_level")),
                        "event_id", "left")
    worst = (F.when((F.col("level") == "hard") | (F.col("_bot_level") == "hard"), "hard")
             .when((F.col("level") == "soft") | (F.col("_bot_level") == "soft"), "soft")
             .otherwise("none"))
    return joined.withColumn("level", worst).drop("key", "_bot_level")


def page_windows(events: DataFrame, minutes: int = 60, late: str | None = None) -> DataFrame:
    """Loads per page and tumbling window. ``late`` sets a watermark for streams."""
    if late is not None:
        events = events.withWatermark("ts", late)
    return (events.groupBy(F.window("ts", f"{minutes} minutes"), "path")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("window_start"), "path", "n"))


def levels_of(events: DataFrame, seconds: DataFrame) -> DataFrame:
    """``events`` (key, ts, event_id, ...) with their level, from the outcome of each
    (key, second) as the stream gives it: calm events come first, rejected ones last."""
    rank = F.row_number().over(Window.partitionBy("key", "second").orderBy("ts", "event_id"))
    rows = events.withColumn("second", F.unix_seconds("ts")).withColumn("_rank", rank).join(seconds, ["key", "second"])
    level = (F.when(F.col("_rank") <= F.col("none"), "none")
             .when(F.col("_rank") <= F.col("none") + F.col("soft"), "soft").otherwise("hard"))
    return rows.select(*events.columns, level.alias("level"))


class RateState:
    """Bucket counters of one key, as a stream sees them second by second."""

    def __init__(self, limit: RateLimit, values: tuple | None = None):
        self.limit = limit
        self.values = list(values) if values else [-2, 0, 0, -2, 0, 0]

    def _roll(self, at: int, bucket: int) -> None:
        last, _prev, now = self.values[at:at + 3]
        if bucket != last:
            self.values[at:at + 3] = [bucket, now if bucket == last + 1 else 0, 0]

    def add(self, second: int, n: int) -> tuple[int, int, int]:
        """How many of ``n`` events of one second are none, soft and hard."""
        lim, v = self.limit, self.values
        self._roll(0, second // lim.short_seconds)
        self._roll(3, second // lim.long_seconds)
        short, long = v[1] + v[2], v[4] + v[5]
        taken = min(n, max(0, 2 * lim.short_hard - short))
        passed = min(taken, max(0, 2 * lim.long_hard - long))
        calm = min(passed, max(0, min(2 * lim.short_soft - short, 2 * lim.long_soft - long)))
        v[2] += taken
        v[5] += passed
        return calm, passed - calm, n - passed

    def until(self) -> int:
        """The second from which on the counters no longer matter."""
        return max((self.values[0] + 2) * self.limit.short_seconds, (self.values[3] + 2) * self.limit.long_seconds)
