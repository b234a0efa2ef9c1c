"""Quality rules whose thresholds adapt to each language and source.

Every text is measured (words, symbols, repeated lines, repeated three-word windows). The
measures that pass the fixed base rule feed quantile sketches: counts per whole value, and
from 4096 on (long words only) per bucket of 1/2048 of a power of two at most. Such sketches merge by addition, in any order, so they are built by one grouped
aggregation with map-side combining and merged upwards from (language, source) to language
to everything. A group's upper fence is ``q75 + spread * (q75 - q25) + slack``; a group with
fewer than ``min_group`` rows takes its language's fence, and a language with fewer takes the
global one. The fences, one row per group, are joined back to the
documents, by broadcast as long as they are few.

Defined results: null text counts as no words and fails the base rule; null language and null
source are groups of their own; repeated rows are judged alike, each on its own; an empty
table gives an empty result. New columns replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from linkloom.llm.common import WHITESPACE, settle, sized, small_batches, whole_row, with_row

# Fixed value: the characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
STATS_TYPE = StructType([StructField(n, LongType()) for n in STATS])


@dataclass(frozen=True)
class RuleSettings:
    """Slack of each measure is in its own unit: per mille, or tenths of a character."""
    min_words: int = 50
    max_repeat_percent: int = 50
    spread: int = 3
    min_group: int = 200
    slack: dict = field(default_factory=lambda: {
        "symbols": 60, "dup_lines": 450, "repeats": 350, "word_length": 40})


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    n = len(number)
    pairs = ids[:-1] * n + ids[1:]
    if n > 2_000_000:  # the codes of windows would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(windows), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift:shift + len(hit)] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    blanks = len(data) - len(data.translate(None, WHITESPACE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return (len(words), len(text or "") - blanks, symbols, len(lines) - len(set(lines)),
            repeated_words(words), len(lines))


def _measure_batch(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=list(STATS), dtype="int64")


# Declared non-deterministic only so that the optimizer never evaluates it twice per row.
measured = F.pandas_udf(_measure_batch, STATS_TYPE).asNondeterministic()


def _ratio(top, bottom, unit):
    return F.floor(unit * top / F.greatest(bottom, F.lit(1))).cast("long")


def bucket(value):
    """The bucket of a value, named by its largest value; exact below 4096, without an end."""
    shift = (F.length(F.bin(value)) - 12).cast("int")
    wide = F.call_function("shiftleft", F.call_function("shiftright", value, shift) + 1, shift) - 1
    return F.when(value < 4096, value).otherwise(wide)


def fences(rows: DataFrame, settings: RuleSettings) -> DataFrame:
    """One row per (lang, source): the upper fence of every measure.

    ``rows`` has _lang, _source, _base_failed and one column per measure.
    """
    names = list(settings.slack)
    cells = (rows.where(~F.col("_base_failed"))
             .select("_lang", "_source", F.explode(F.array(*[
                 F.struct(F.lit(n).alias("measure"), bucket(F.col(n)).alias("bucket"))
                 for n in names])).alias("c"))
             .groupBy("_lang", "_source", "c.measure", "c.bucket").agg(F.count(F.lit(1)).alias("n")))

    def cut(sketch: DataFrame, keys: list[str], out: str) -> DataFrame:
        # A window holds one sketch: 1001 buckets for shares, 2048 per power of two beyond 4096.
        w = Window.partitionBy(*keys, "measure")
        got = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
        at = lambda q: F.min(F.when(F.col("upto") * 100 >= q * F.col("total"), F.col("bucket")))
        got = got.groupBy(*keys, "measure").agg(at(25).alias("q25"), at(75).alias("q75"),
                                                F.max("total").alias("total"))
        slack = F.create_map(*[F.lit(x) for kv in settings.slack.items() for x in kv])
        fence = F.col("q75") + settings.spread * (F.col("q75") - F.col("q25")) + slack[F.col("measure")]
        got = got.withColumn("fence", F.when(F.col("total") >= settings.min_group, fence))
        # Without keys this is the last resort, whatever its size.
        if not keys:
            got = got.withColumn("fence", fence)
        wide = [F.max(F.when(F.col("measure") == n, F.col("fence"))).alias(f"{out}_{n}") for n in names]
        return got.groupBy(*keys).agg(*wide)

    by_lang = cells.groupBy("_lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    own, lang, all_ = cut(cells, ["_lang", "_source"], "own"), cut(by_lang, ["_lang"], "lang"), cut(overall, [], "all")
    got = own.withColumnRenamed("_lang", "_l").join(lang, F.col("_l").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    # One row of fences for everything: a constant joined by key.
    got = got.withColumn("_one", F.lit(1)).join(all_.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return got.select(F.col("_l").alias("_fence_lang"), F.col("_source").alias("_fence_source"), *[
        F.coalesce(f"own_{n}", f"lang_{n}", f"all_{n}").alias(f"fence_{n}") for n in names])


def apply_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                settings: RuleSettings = RuleSettings()) -> DataFrame:
    """The documents with their measures, ``base_failed``, ``failed`` (the names of the
    adaptive rules that were broken) and ``kept``.

    The texts are measured once for the sketches and once for the verdict; that reads the
    input twice but moves no text through a shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    c = F.col
    rows = docs.select(whole_row(docs).alias("_row"), c(f"`{lang}`").alias("_lang"),
                       c(f"`{source}`").alias("_source"), measured(c(f"`{text}`").cast("string")).alias("_m"))
    rows = rows.select("_row", "_lang", "_source", *[c(f"_m.{n}").alias(n) for n in STATS])
    rows = rows.withColumns({
        "_base_failed": (c("n_words") < settings.min_words)
        | (100 * c("n_repeat_words") > settings.max_repeat_percent * c("n_words")),
        "symbols": _ratio(c("n_symbols"), c("word_chars"), 1000),
        "dup_lines": _ratio(c("n_dup_lines"), c("n_lines"), 1000),
        "repeats": _ratio(c("n_repeat_words"), c("n_words"), 1000),
        "word_length": _ratio(c("word_chars"), c("n_words"), 10),
    })
    limits = sized(settle(fences(rows, settings)))
    names = list(settings.slack)
    joined = rows.join(limits, c("_lang").eqNullSafe(c("_fence_lang"))
                       & c("_source").eqNullSafe(c("_fence_source")), "left")
    failed = F.filter(F.array(*[F.when(c(n) > c(f"fence_{n}"), F.lit(n)) for n in names]),
                      lambda x: x.isNotNull())
    joined = joined.withColumn("_failed", failed)
    return with_row(joined, "_row", [*STATS, "base_failed", "failed", "kept"],
                    [*[c(n) for n in STATS], c("_base_failed"), c("_failed"),
                     ~c("_base_failed") & (F.size("_failed") == 0)])
