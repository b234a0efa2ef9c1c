"""Mixing sources to target weights with Sainte-Lague quotas of equal-token blocks.

1. Targets: the sources share ``share`` times all tokens by weight; a target stops at ``cap``
   times its source, and the excess is shared again by weight until none is above.
2. Each source is dealt into shards by a seeded hash of the id, many for a hot source, but
   none of fewer than ``shard_rows`` rows or ``shard_blocks`` blocks on average. A shard's
   documents, in seeded order, form one token stream that is cut into blocks of equal size
   (``block`` tokens, up to rounding; fewer in a source of under 64 such blocks).
3. Sainte-Lague's highest quotients (w/1, w/3, w/5 ...) give every source its number of seats,
   of the size of the smallest block. They count as many of the source's own blocks as hold
   the same tokens, which are dealt in the same way to its shards.
4. A shard with n blocks and q seats takes every block q // n times, and q % n blocks once
   more; which ones follows from a seeded permutation of the block numbers, so that no block
   is ever listed or sorted.

The tables that meet in one place are one row per source and one per shard (``shards`` plus
the number of sources at most); documents are only summed, ranked inside a shard, and joined
with their shard's quota.

Defined results: a null text has size 0 and is never taken; null sources form one source, the
last in order; a source without tokens has target 0; repeated rows are taken each on its own;
null ids all hash alike and are split by the hash of the whole row; an empty table gives an
empty result. New columns replace input columns of the same name.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import re
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkloom.llm.common import local_table, settle, sized, small_batches, whole_row, with_row

#: A word's pattern over bytes, and the same white space for Spark's functions.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class MixSettings:
    weights: tuple = (3, 1, 2)
    share: float = 1.5
    cap: float = 2.0
    block: int = 128
    shards: int = 4096
    shard_rows: int = 16
    shard_blocks: int = 32
    seed: int = 17


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    bare = F.btrim(text.cast("string"), F.lit(BLANK))
    many = F.size(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0).otherwise(many).cast("long")


def targets(sizes: list[tuple[str | None, int]], s: MixSettings = MixSettings()) -> list[tuple[str | None, int, float]]:
    """(source, size, target) in the order that deals out the weights."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [s.weights[i % len(s.weights)] for i in range(len(order))]
    got: dict[int, float] = {}
    left, active = s.share * sum(n for _, n in order), set(range(len(order)))
    while active:
        level = left / sum(weight[i] for i in active)
        over = [i for i in sorted(active) if weight[i] * level > s.cap * order[i][1]]
        if not over:
            got |= {i: weight[i] * level for i in active}
            break
        for i in over:
            got[i] = s.cap * order[i][1]
            left -= got[i]
            active.discard(i)
    return [(name, n, float(got[i])) for i, (name, n) in enumerate(order)]


def apportion(weights, caps, seats: int) -> list[int]:
    """Sainte-Lague: seats by the highest quotients w / (2k + 1), at most ``caps`` each;
    ties go to the earlier one.

    A divisor that gives too few seats is found by bisection; the rest goes quotient by quotient.
    """
    w, c = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    seats = min(int(seats), int(c[w > 0].sum())) if len(w) else 0
    if seats <= 0:
        return [0] * len(w)
    at = lambda d: np.minimum(c, np.floor(w / d + 0.5)).astype(np.int64)
    low, high = w.max() / (4.0 * (seats + len(w)) * max(1.0, w.max())), 3 * w.max()
    while at(low).sum() < seats:
        low /= 16
    for _ in range(200):
        mid = (low + high) / 2
        if at(mid).sum() < seats:
            high = mid
        else:
            low = mid
    got = at(high)
    heap = [(-w[i] / (2 * int(got[i]) + 1), i) for i in range(len(w)) if w[i] > 0 and got[i] < c[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < c[i]:
            heapq.heappush(heap, (-w[i] / (2 * int(got[i]) + 1), i))
    return got.tolist()


def block_of(tokens: int, s: MixSettings = MixSettings()) -> int:
    """The block size of a source: halved until it has 64 blocks, one token at least."""
    block = s.block
    while block > 1 and tokens < 64 * block:
        block //= 2
    return block


def cut_of(rows: int, tokens: int, everything: int, s: MixSettings = MixSettings()) -> int:
    """Into how many shards a source is dealt, of ``everything`` rows of all sources."""
    return max(1, min(math.ceil(s.shards * rows / everything), math.ceil(rows / s.shard_rows),
                      tokens // (s.shard_blocks * block_of(tokens, s))))


def quotas(shards: list[tuple[str | None, int, int]], s: MixSettings = MixSettings()) -> list[tuple]:
    """From (source, shard, tokens) one row per shard: (source, shard, tokens, source_size,
    target, blocks, passes, extra, step, first)."""
    total: dict[str | None, int] = {}
    for source, _, tokens in shards:
        total[source] = total.get(source, 0) + tokens
    goal = targets(list(total.items()), s)
    shards = sorted(shards, key=lambda x: (x[0] is None, x[0] or "", x[1]))
    blocks = [max(1, round(t / block_of(total[source], s))) if t else 0 for source, _, t in shards]
    mine: dict[str | None, list[int]] = {}
    for i, (source, _, _) in enumerate(shards):
        mine.setdefault(source, []).append(i)
    unit = min([block_of(n, s) for _, n, _ in goal if n], default=s.block)
    seats = apportion([g for *_, g in goal], [math.ceil(s.cap * n / unit) for _, n, _ in goal],
                      round(sum(g for *_, g in goal) / unit))
    out = []
    for (source, size, target), q in zip(goal, seats):
        # Seats by the tokens that the source's blocks really hold.
        q = round(q * unit * sum(blocks[i] for i in mine[source]) / size) if size else 0
        each = apportion([shards[i][2] for i in mine[source]], [int(s.cap * blocks[i]) for i in mine[source]], q)
        for i, q_i in zip(mine[source], each):
            n = blocks[i]
            step, first = 1, 0
            if n > 1:
                key = f"{source}\0{shards[i][1]}".encode("utf-8", "surrogatepass")
                step = xxhash.xxh64_intdigest(key, s.seed) % n
                first = xxhash.xxh64_intdigest(key, s.seed + 1) % n
                while math.gcd(step, n) != 1:
                    step = (step + 1) % n
            out.append((source, shards[i][1], shards[i][2], size, target, n,
                        q_i // n if n else 0, q_i % n if n else 0, step, first))
    return out


QUOTA = {"_q_source": pa.string(), "_q_shard": pa.int64(), "_tokens": pa.int64(), "_source_size": pa.int64(),
         "_target": pa.float64(), **dict.fromkeys(["_n", "_passes", "_extra", "_step", "_first"], pa.int64())}


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size",
        settings: MixSettings = MixSettings()) -> DataFrame:
    """The documents with source_size, target, passes (how often the whole document is
    taken), spans (word ranges taken once more) and taken (words, repeats counted)."""
    spark, c, s = docs.sparkSession, F.col, settings
    h = F.xxhash64(c(f"`{doc_id}`"), F.lit(s.seed))
    # Documents without an id would all share one hash.
    h = F.when(c(f"`{doc_id}`").isNull(), F.xxhash64(*[c(f"`{x}`") for x in docs.columns])).otherwise(h)
    key = [c(f"`{source}`").cast("string").alias("_source"), h.alias("_h"),
           F.coalesce(c(f"`{size}`"), F.lit(0)).cast("long").alias("_size")]
    narrow = settle(docs.select(*key))
    counts = narrow.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("t")).collect()
    everything = max(1, sum(r.n for r in counts))
    cuts = [(r["_source"], cut_of(r.n, r.t, everything, s)) for r in counts]
    cut = sized(local_table(spark, cuts, {"_c_source": pa.string(), "_cut": pa.int64()}), len(cuts))

    def dealt(rows: DataFrame) -> DataFrame:
        return (rows.join(cut, c("_source").eqNullSafe(c("_c_source")), "left")
                .withColumn("_shard", F.pmod(c("_h"), c("_cut"))))

    found = dealt(narrow).groupBy("_source", "_shard").agg(F.sum("_size").alias("t")).collect()
    quota = local_table(spark, quotas([(r["_source"], r["_shard"], r.t) for r in found], s), QUOTA)
    rows = docs.select(whole_row(docs).alias("_row"), c(f"`{doc_id}`").alias("_id"), *key)
    order = Window.partitionBy("_source", "_shard").orderBy("_h", "_id", "_size", F.xxhash64("_row"))
    rows = dealt(rows).withColumn("_end", F.sum("_size").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.join(sized(quota, len(found)), c("_source").eqNullSafe(c("_q_source")) & (c("_shard") == c("_q_shard")), "left")
    # Block j holds the tokens from j * tokens // n on; a document touches blocks _b0 to _b1.
    rows = rows.withColumns({"_start": c("_end") - c("_size")})
    rows = rows.withColumns({"_b0": F.expr("((_start + 1) * _n - 1) div _tokens"),
                             "_b1": F.expr("(_end * _n - 1) div _tokens")})
    spans = F.expr("""transform(filter(sequence(_b0, _b1), j -> pmod(j * _step + _first, _n) < _extra), j -> struct(
        greatest(_start, j * _tokens div _n) - _start as start,
        least(_end, (j + 1) * _tokens div _n) - _start as end))""")
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    rows = rows.withColumn("_spans", F.when((c("_size") > 0) & (c("_extra") > 0), spans).otherwise(none))
    taken = c("_passes") * c("_size") + F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return with_row(rows, "_row", ["source_size", "target", "passes", "spans", "taken"],
                    [c("_source_size"), c("_target"), c("_passes"), c("_spans"), taken])


def _cut_batch(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for text, first, last in zip(texts, starts, ends):
        if first is None:
            out.append(None)
            continue
        data = (text or "").encode("utf-8", "surrogatepass")
        at = [m.span() for m in WORD.finditer(data)]
        ranges: list[list[int]] = []
        for a, b in zip(first, last):
            if ranges and ranges[-1][1] == a:
                ranges[-1][1] = b
            else:
                ranges.append([a, b])
        parts = [data[at[a][0]:at[b - 1][1]] for a, b in ranges]
        out.append(b"\n".join(parts).decode("utf-8", "surrogatepass"))
    return pd.Series(out, dtype="object")


cut_text = F.pandas_udf(_cut_batch, StringType())


def write_out(mixed: DataFrame, columns: list[str], text: str = "text", size: str = "size",
              n_chars: str | None = None) -> DataFrame:
    """One row per taken copy: the whole text for each pass, the taken word ranges for the
    rest (neighbouring ranges in one piece, others on lines of their own)."""
    small_batches(mixed.sparkSession)
    c = F.col
    full = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]) == c(size)
    more = F.size("spans") > 0
    # One pass: a row for each whole copy, and one for the part; only parts go to the cutter.
    whole = c("passes") + F.when(more & full, 1).otherwise(0)
    kinds = F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.array_repeat(F.lit(True), (more & ~full).cast("int")))
    rows = mixed.withColumn("_part", F.explode(kinds))
    part = F.when(c("_part"), c(f"`{text}`"))
    rows = rows.withColumn("_cut", cut_text(part, F.when(c("_part"), c("spans.start")), F.when(c("_part"), c("spans.end"))))
    rows = rows.withColumn(text, F.when(c("_part"), c("_cut")).otherwise(c(f"`{text}`")))
    if n_chars:
        cut_size = F.length(text).cast(mixed.schema[n_chars].dataType)
        rows = rows.withColumn(n_chars, F.when(c("_part"), cut_size).otherwise(c(f"`{n_chars}`")))
    return rows.select(*[c(f"`{x}`") for x in columns])
