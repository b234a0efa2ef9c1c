"""Language identification by prediction by partial matching (PPM).

Training counts, for every language, each byte after its three preceding bytes (a text is
preceded by three line feeds), over all training texts. The counts of shorter contexts are
sums of these. With the statistics frozen, a byte's code length under a language is exact:

    P(byte | context) = count / (n + d)                   if seen in this context
                      = d / (n + d) * P(byte | shorter)   else (escape, method C)

with n the context's occurrences and d its distinct successors; an unseen context costs no
escape, and the empty context escapes to 1/256. A text belongs to the language that codes
its bytes, letter case folded, most briefly.

All counted nodes are the model; none is cut, so it grows with what the corpus holds. It is a
written table. While it has few nodes (counted first) it is broadcast: the code lengths of
all deepest nodes under all languages form one table, a byte is one hash lookup in it, and only
contexts outside the table take the escapes step by step. A larger model is dealt by the two
bytes before the coded one, which contexts of three and of two bytes share; texts' windows,
counted per text first, come to its parts, and their code lengths are added up per text. Both
ways give the same lengths.

Defined results: null text, or text without a letter, is ``und`` with score 0; null
languages are not learned; without any training text everything is ``und``; repeated rows
are learned as often as they occur and predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from linkloom.llm.common import partitions, small_batches, stored

ORDER = 3
#: A model of this many (node, language) pairs at most is broadcast (some 150 MB in a task).
BROADCAST_NODES = 12_000_000
#: Nodes of a part of a larger model.
PART_NODES = 1_000_000
UNKNOWN = "und"
_PAD = b"\n" * ORDER
_LETTER = regex.compile(r"\p{L}")


def encoded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def grams(data: np.ndarray) -> np.ndarray:
    """The four-byte windows that end at each byte after the padding, first byte highest."""
    d = data.astype(np.uint32)
    return (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


# ---------------------------------------------------------------- training

def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (lang, gram) of a task, merged as it goes."""
    kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def merge(lang: str, keys: np.ndarray, n: np.ndarray) -> None:
        if lang in kept:
            keys, n = np.concatenate([kept[lang][0], keys]), np.concatenate([kept[lang][1], n])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        kept[lang] = keys[first], np.add.reduceat(n, first)

    def rows() -> Iterator[pd.DataFrame]:
        for lang, (keys, n) in kept.items():
            yield pd.DataFrame({"lang": lang, "gram": keys.astype(np.int64), "n": n})
        kept.clear()

    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            window: list[bytes] = []
            size = 0
            for text in [*texts, None]:
                if text is not None:
                    window.append(_PAD + encoded(text))
                    size += len(window[-1])
                if window and (text is None or size > 8_000_000):
                    data = np.frombuffer(b"".join(window), dtype=np.uint8)
                    ends = np.cumsum([len(x) for x in window])[:-1]
                    found = grams(data)
                    # Windows that run from one text into the next one's padding.
                    inside = np.ones(len(found), dtype=bool)
                    for back in range(ORDER):
                        inside[ends - ORDER + back] = False
                    keys, n = np.unique(found[inside], return_counts=True)
                    if len(keys):
                        merge(lang, keys, n.astype(np.int64))
                    window, size = [], 0
        if sum(len(k) for k, _ in kept.values()) > 2_000_000:
            yield from rows()  # bounded memory; the shuffle merges them
    yield from rows()


@dataclass
class Statistics:
    """Frozen counts: (lang, o, gram, n) for the orders 3 and 2, a written table, and the orders 1 and 0
    of each language (65,792 nodes at most) as sorted keys and counts."""
    langs: list[str]
    nodes: DataFrame
    low: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]
    deepest: int
    size: int

    @property
    def small(self) -> bool:
        return max(self.size, self.deepest * len(self.langs)) <= BROADCAST_NODES


def _levels(got: pd.DataFrame, name: str, orders: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for o in orders:
        part = got[(got["lang"] == name) & (got["o"] == o)].sort_values("gram")
        out[o] = part["gram"].to_numpy(dtype=np.int64), part["n"].to_numpy(dtype=np.float64)
    return out


def statistics(training: DataFrame, lang: str = "lang", text: str = "text") -> Statistics:
    small_batches(training.sparkSession)
    c = F.col
    rows = training.select(c(f"`{lang}`").alias("lang"), c(f"`{text}`").cast("string").alias("text")).dropna()
    deep = stored(rows.mapInPandas(_count, "lang string, gram long, n long")
                  .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    shorter = lambda o: F.struct(F.lit(o).alias("o"), c("gram").bitwiseAND(F.lit((1 << 8 * (o + 1)) - 1)).alias("gram"))
    shallow = stored(deep.select("lang", "n", F.explode(F.array(*map(shorter, (2, 1, 0)))).alias("x"))
                     .groupBy("lang", "x.o", "x.gram").agg(F.sum("n").alias("n")), "short-grams")
    low = shallow.where("o < 2").toPandas()  # 65,792 nodes a language at most
    langs = sorted(low["lang"].unique())
    second = shallow.where("o = 2")
    nodes = deep.select("lang", F.lit(3).alias("o"), "gram", "n").unionByName(second)
    return Statistics(langs, nodes, {x: _levels(low, x, (1, 0)) for x in langs}, deep.select("gram").distinct().count(),
                      deep.count() + second.count())


class ContextTree:
    """One language's frozen statistics."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.keys, self.cost, self.contexts, self.escape = {}, {}, {}, {}
        for o, (keys, n) in levels.items():
            context, at = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.bincount(at, weights=n), np.bincount(at)
            self.keys[o] = keys
            self.cost[o] = -np.log2(n / (total + kinds)[at]) if len(keys) else n
            self.contexts[o] = context
            self.escape[o] = -np.log2(kinds / (total + kinds)) if len(keys) else n

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
        return at, (table[at] == keys) if len(table) else np.zeros(len(keys), dtype=bool)

    def bits(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Exact code lengths of the last byte of each key after its context."""
        if order < 0:
            return np.full(len(keys), 8.0)
        at, hit = self._find(self.keys[order], keys)
        out = np.empty(len(keys))
        out[hit] = self.cost[order][at[hit]]
        rest = keys[~hit]
        if len(rest):
            ctx, seen = self._find(self.contexts[order], rest >> 8)
            cost = np.zeros(len(rest))
            cost[seen] = self.escape[order][ctx[seen]]
            out[~hit] = cost + self.bits(rest & ((1 << 8 * order) - 1), order - 1)
        return out


# ---------------------------------------------------------------- prediction

class Model:
    """All languages' code lengths in one hash table over four-byte windows."""

    def __init__(self, levels: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]):
        self.langs = sorted(levels)
        self.trees = [ContextTree(levels[x]) for x in self.langs]
        keys = np.unique(np.concatenate([t.keys[ORDER] for t in self.trees])) if self.trees else np.zeros(0, np.int64)
        self.keys = keys.astype(np.uint32)
        self.table = np.stack([t.bits(keys) for t in self.trees], axis=1).astype(np.float32) if self.trees else None
        self.shift = np.uint32(32 - max(8, int(len(keys) * 8).bit_length()))
        self.slots: np.ndarray | None = None

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> self.shift

    def _build(self) -> None:
        """Open addressing; built where it is used, since it is larger than what it is made of."""
        size = 1 << int(32 - int(self.shift))
        self.slots = np.full(size + 64, -1, dtype=np.int32)
        todo, at = np.arange(len(self.keys), dtype=np.int32), self._hash(self.keys).astype(np.int64)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], at[lost] + 1
            if len(at) and at.max() >= len(self.slots):
                self.slots = np.r_[self.slots, np.full(64, -1, dtype=np.int32)]

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Table rows of the windows, -1 for those outside."""
        if self.slots is None:
            self._build()
        at = self._hash(keys)
        row = self.slots[at]
        out = np.where((row >= 0) & (self.keys[row] == keys), row, -1)
        todo = np.flatnonzero((out < 0) & (row >= 0))
        step = 1
        while len(todo):
            row = self.slots[at[todo].astype(np.int64) + step]
            hit = (row >= 0) & (self.keys[row] == keys[todo])
            out[todo[hit]] = row[hit]
            todo = todo[(row >= 0) & ~hit]
            step += 1
        return out

    def lengths(self, texts: list[bytes], chunk: int = 1 << 19) -> np.ndarray:
        """Code length in bits of every text under every language."""
        out = np.zeros((len(texts), len(self.langs)))
        data = np.frombuffer(b"".join(_PAD + t for t in texts), dtype=np.uint8)
        first = np.cumsum([0] + [len(t) + ORDER for t in texts])[:-1]
        for start in range(0, len(data) - ORDER, chunk):
            keys = grams(data[start:start + chunk + ORDER])
            row = self.rows(keys)
            cost = self.table[row]
            miss = np.flatnonzero(row < 0)
            if len(miss):
                far = keys[miss].astype(np.int64)
                for k, tree in enumerate(self.trees):
                    cost[miss, k] = tree.bits(far)
            # Windows of text i begin at its padding; the last ORDER run into the next text.
            i = np.searchsorted(first, start, side="right") - 1
            while i < len(texts) and first[i] < start + len(keys):
                a, b = max(first[i], start) - start, min(first[i] + len(texts[i]) - start, len(keys))
                if b > a:
                    out[i] += cost[a:b].sum(axis=0, dtype=np.float64)
                i += 1
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior under equal priors); ties go to the first name."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        if known:
            bits = self.lengths([encoded(texts[i]) for i in known])
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
            for i, k, p in zip(known, best, share):
                out[i] = self.langs[k], float(p)
        return out


def learn(training: DataFrame, lang: str = "lang", text: str = "text") -> Statistics:
    return statistics(training, lang, text)


def whole_model(stats: Statistics) -> Model:
    """All code lengths in one place; for models that are ``small``."""
    got = stats.nodes.toPandas()
    return Model({x: stats.low[x] | _levels(got, x, (3, 2)) for x in stats.langs})


def identify(docs: DataFrame, stats: Statistics, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with lang_pred and score; only the text is looked at."""
    if not stats.small:
        return _identify_in_parts(docs, stats, keep, text)
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(whole_model(stats))  # its size was counted

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(list(texts)), columns=["lang_pred", "score"])

    guess = F.pandas_udf(run, StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    rows = docs.select(*[F.col(f"`{x}`") for x in keep],
                       guess.asNondeterministic()(F.col(f"`{text}`").cast("string")).alias("_g"))
    return rows.select(*[F.col(f"`{x}`") for x in keep], "_g.lang_pred", "_g.score")


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(row, gram, times) of every text with a letter; a long text piece by piece."""
    for batch in batches:
        out, size = [], 0
        for row, text in zip(batch["row"].tolist(), batch["text"]):
            if not text or not _LETTER.search(text):
                continue
            data = np.frombuffer(_PAD + encoded(text), dtype=np.uint8)
            for at in range(0, len(data) - ORDER, 1 << 20):
                keys, n = np.unique(grams(data[at:at + (1 << 20) + ORDER]), return_counts=True)
                out.append(pd.DataFrame({"row": row, "gram": keys.astype(np.int64), "times": n}))
                size += len(keys)
                if size > 200_000:
                    yield pd.concat(out, ignore_index=True)
                    out, size = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)


def _identify_in_parts(docs: DataFrame, stats: Statistics, keep: list[str], text: str) -> DataFrame:
    spark, c = docs.sparkSession, F.col
    small_batches(spark)
    # The texts are numbered in a table of their own, so that a number stays with its row.
    rows = stored(docs.select(*[c(f"`{x}`").alias(f"keep{i}") for i, x in enumerate(keep)], c(f"`{text}`").cast("string").alias("text"))
                  .withColumn("row", F.monotonically_increasing_id()), "texts")
    parts = max(1, -(-stats.size // PART_NODES))
    part = F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))), F.lit(parts)).cast("int").alias("part")
    place = {x: i for i, x in enumerate(stats.langs)}
    number = F.coalesce(*[F.when(c("lang") == x, F.lit(i)) for x, i in place.items()])
    none = lambda x, t: F.lit(None).cast(t).alias(x)
    model = stats.nodes.select(part, F.lit(0).alias("kind"), number.alias("lang"), "o", "gram", "n", none("row", "bigint"))
    asked = rows.select("row", "text").mapInPandas(_windows, "row bigint, gram bigint, times bigint").select(
        part, none("lang", "int"), none("o", "int"), "gram", c("times").alias("n"), "row")
    # A frequent pair of bytes has many windows; each part's windows are cut over several tasks,
    # which all read the part's nodes.
    cuts = max(1, partitions(spark) // parts)
    cut = F.pmod(F.xxhash64("row"), F.lit(cuts)).cast("int").alias("cut")
    model = model.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    asked = asked.withColumn("kind", F.lit(1)).withColumn("cut", cut)
    both = (model.unionByName(asked).withColumn("task", c("part") * cuts + c("cut"))
            .repartitionById(parts * cuts, c("task")).sortWithinPartitions("kind"))
    low = spark.sparkContext.broadcast([stats.low[x] for x in stats.langs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes: list[pd.DataFrame] = []
        trees: list[ContextTree] = []
        for batch in batches:
            mine = batch[batch["kind"] == 0]
            if len(mine):
                nodes.append(mine[["lang", "o", "gram", "n"]])
            here = batch[batch["kind"] == 1]
            if not len(here):
                continue
            if not trees:
                got = pd.concat(nodes) if nodes else mine
                trees, nodes = [ContextTree(x | _levels(got, k, (3, 2))) for k, x in enumerate(low.value)], []
            keys, at = np.unique(here["gram"].to_numpy(dtype=np.int64), return_inverse=True)
            names, text_of = np.unique(here["row"].to_numpy(dtype=np.int64), return_inverse=True)
            for k, tree in enumerate(trees):
                bits = np.bincount(text_of, weights=tree.bits(keys)[at] * here["n"].to_numpy(dtype=np.float64))
                yield pd.DataFrame({"row": names, "lang": k, "bits": bits})

    sums = both.mapInPandas(run, "row bigint, lang int, bits double").groupBy("row", "lang").agg(F.sum("bits").alias("bits"))
    best = sums.groupBy("row").agg(F.min(F.struct("bits", "lang")).alias("best"), F.collect_list("bits").alias("all"))
    share = F.aggregate("all", F.lit(0.0), lambda a, b: a + F.pow(F.lit(2.0), F.greatest(c("best.bits") - b, F.lit(-1000.0))))
    names = F.array(*[F.lit(x) for x in stats.langs])
    told = best.select(c("row").alias("_row"), names[c("best.lang")].alias("lang_pred"), (1 / share).alias("score"))
    return (rows.join(told, c("row") == c("_row"), "left")
            .select(*[c(f"keep{i}").alias(x) for i, x in enumerate(keep)],
                    F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score")))
