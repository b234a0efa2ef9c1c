"""All pairs of texts whose sets of word shingles have a Jaccard similarity of ``percent`` or
more, by prefix filtering and an exact check.

1. Texts with the same words are one node, named by the 64-bit hash of the words.
2. A set of n shingles that is similar to another shares at least ceil(p * n) shingles with
   it. So when every set is put in one common order, a similar pair has a common shingle
   among the first n - ceil(p * n) + 1 of both. These shingles are the keys; no pair is lost,
   whatever the order. Rare shingles come first, so that common passages are no keys as long as
   a text has anything of its own: the order is by how often all texts have a shingle, counted
   in 2^20 cells that its hash falls into, then by hash. The counts only decide how many
   candidates there are, never which pairs are found.
3. Candidates fit in size and share enough keys: whichever of two sets has the smaller last
   key shares none of its keys beyond those counted, so both together share at most the
   counted keys and what follows the keys of one. First, each key links only neighbours by size,
   which are checked; what is then in one component needs no more links. Second, while that
   still finds links, nodes of keys that meet many of other components are checked against the next few of
   their key in a random order that changes from round to round, so that a large group of near copies becomes one component by a
   few links a node. Third, all candidates of a key that lie in different components are paired where the key can be the first that they share: sets of n and m must share s = ceil(p * (n + m) / (1 + p)),
   so it has at least s - 1 shingles behind it in both. Their bitmaps must allow it, too: a bitmap has the parity of a set's
   members in each of 256 cells, so two of them differ in no more places than the sets have members of their own,
   which are n + m - 2 s at most. Pairs are checked. A key whose nodes would still meet more than
   ``CROWD`` nodes of other components each is split, exactly: similar sets share at least l of their first
   n - ceil(p * n) + l shingles, so its nodes are dealt again by their next shingle in the order,
   up to ``DEPTH`` shingles together; the last of them has s - l shingles behind it. No key makes all pairs
   of a crowd that shares one passage.

Shingles are compared by their 64-bit hashes. A text with fewer words than a shingle is one
shingle, and blank or null texts are one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from linkloom.llm.common import lean, settle, sized, small_batches, stored

SEED = 42
#: Cells that shingles are counted in, and the cells of a row when counts are added up.
CELLS, ROW = 1 << 20, 4096
#: A key whose nodes meet more nodes of other components is split by further shingles, up to so
#: many together.
CROWD, DEPTH = 1000, 4
#: Splitting a key gives its nodes a row per further shingle; it pays beyond so many pairs for each.
SPLIT_COST = 10
#: Rounds that link nodes with the next so many of a key, where a node meets more than so many.
ROUNDS, NEXT, FEW = 2, 4, 8
#: Cells of a bitmap, kept as words of 64 bits.
BITS = 256
BITMAP = [f"w{i}" for i in range(BITS // 64)]
#: Nodes a task remembers, so that it gives out copies once; others are merged later.
REMEMBERED = 200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def node(text: str | None) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words_of(text)), SEED)


def _node_batch(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([node(t) for t in texts], dtype=np.uint64).view(np.int64))


#: Non-deterministic only so that it is evaluated once per row.
nodes = F.pandas_udf(_node_batch, LongType()).asNondeterministic()


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts, stops = [0, *(ends[:len(words) - k] + 1).tolist()], ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64).view(np.int64))


def ordered(own: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
    """A set in the common order."""
    return own if counts is None else own[np.lexsort((own, counts[own & (CELLS - 1)]))]


def prefix(n: int, percent: int, shared: int = 1) -> int:
    """Of how many first shingles a set of n shares ``shared`` with any similar one."""
    return min(n, n - -(-percent * n // 100) + shared) if n else 0


def bitmap(own: np.ndarray) -> np.ndarray:
    """The parity of a set's members in each cell of their hashes' upper bits."""
    odd = np.bincount((own.view(np.uint64) >> np.uint64(40)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _once(shingle: int, emit: Callable[[int, np.ndarray], pd.DataFrame]):
    """For mapInPandas over (node, text): ``emit`` for the nodes a task has not seen yet."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            out, rows = [], 0
            for name, text in zip(batch["node"].tolist(), batch["text"]):
                if name in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(name)
                out.append(emit(name, shingles(text, shingle)))
                rows += len(out[-1])
                if rows > 100_000:
                    yield pd.concat(out, ignore_index=True)
                    out, rows = [], 0
            if out:
                yield pd.concat(out, ignore_index=True)
    return lean(run)


def _counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many texts have a shingle of each cell; a row per ``ROW`` cells and task, with the counts that
    are not zero. Tasks with few texts are many, and most of their counts are."""
    most = np.iinfo(np.int32).max

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, size, seen = np.zeros(CELLS, dtype=np.int64), [], 0, set()
        for batch in batches:
            for name, text in zip(batch["node"].tolist(), batch["text"]):
                if name in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(name)
                held.append(shingles(text, shingle) & (CELLS - 1))
                size += len(held[-1])
                if size > 250_000:
                    total += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=CELLS)
        some = np.flatnonzero(total)
        if len(some):
            at = some // ROW
            cuts = np.flatnonzero(np.diff(at)) + 1
            yield pd.DataFrame({"at": at[np.r_[0, cuts]], "cell": np.split((some % ROW).astype(np.int32), cuts),
                                "n": np.split(np.minimum(total[some], most).astype(np.int32), cuts)})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, cell, n in zip(batch["at"], batch["cell"], batch["n"]):
                sums.setdefault(at, np.zeros(ROW, dtype=np.int64))[cell] += n
        if sums:
            yield pd.DataFrame({"at": list(sums), "n": list(sums.values())})

    parts = texts.mapInPandas(lean(count), "at int, cell array<int>, n array<int>").repartition("at")
    parts = parts.mapInPandas(lean(add), "at int, n array<bigint>")
    out = np.zeros((CELLS // ROW, ROW), dtype=np.int64)
    for r in parts.collect():  # the cells, whatever the number of texts
        out[r["at"]] = r["n"]
    return np.minimum(out.reshape(-1), most).astype(np.int32)


def named_texts(docs: DataFrame, text: str) -> DataFrame:
    """(node, text) of every row, stored: each step that needs the texts reads them again, in a task
    of its own Python worker only, without the one that names nodes beside it."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    return stored(plain.select(nodes(F.col("text")).alias("node"), "text"), "near-sets-texts")


def links(docs: DataFrame, text: str, shingle: int, percent: int, counted: bool = True,
          given: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(a, b): nodes with similar sets, enough of them to connect all that are connected.

    ``given`` are candidates (a, na, b, nb) found in another way, na and nb the sizes of their sets;
    they are checked first, and what they connect needs no more links. ``texts`` are the
    ``named_texts`` of ``docs``, if they are there already."""
    from linkloom.llm.simhash import components

    c = F.col
    small_batches(docs.sparkSession)
    texts = named_texts(docs, text) if texts is None else texts
    sent = docs.sparkSession.sparkContext.broadcast(_counts(texts, shingle) if counted else None)

    def emit(name: int, own: np.ndarray) -> pd.DataFrame:
        keys = ordered(own, sent.value)[:prefix(len(own), percent)]
        return pd.DataFrame({"key": keys, "node": name, "n": len(own), "at": np.arange(len(keys))})

    cells = texts.mapInPandas(_once(shingle, emit), "key bigint, node bigint, n int, at int")
    by_key = Window.partitionBy("key")
    cells = cells.repartition("key").dropDuplicates(["key", "node"])
    # Keys of one node make no pair; the others are kept with their neighbour by size.
    near = by_key.orderBy("n", "node")
    cells = stored(cells.withColumns({"_node": F.lag("node").over(near), "_n": F.lag("n").over(near),
                                      "_next": F.lead("node").over(near)})
                   .where(c("_node").isNotNull() | c("_next").isNotNull()).drop("_next"), "near-sets")

    def fits(n, m):
        return F.least(n, m) * 100 >= F.greatest(n, m) * percent

    def checked(shared: DataFrame, least: bool = True) -> DataFrame:
        """From one row (a, na, b, nb) per shared key; with ``least``, of pairs that have enough such rows."""
        behind = F.greatest(*[F.ceil(c(n) * percent / 100) - 1 for n in ("na", "nb")])
        enough = (c("k") + behind) * (100 + percent) >= (c("na") + c("nb")) * percent
        pairs = settle(shared.where(fits(c("na"), c("nb"))).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k"))
                       .where(enough if least else F.lit(True)).select("a", "b"))
        wanted = settle(pairs.select(c("a").alias("_w")).union(pairs.select("b")).distinct())
        full = (texts.join(sized(wanted), c("node") == c("_w"), "left_semi")
                .mapInPandas(_once(shingle, lambda name, own: pd.DataFrame({"node": [name], "own": [own]})),
                             "node bigint, own array<bigint>").dropDuplicates(["node"]))
        full = stored(full, "near-sets-full")
        both = (pairs.join(full.select(c("node").alias("a"), c("own").alias("x")), "a")
                .join(full.select(c("node").alias("b"), c("own").alias("y")), "b"))
        common = F.size(F.array_intersect("x", "y"))
        return settle(both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b"))

    # Neighbours by size are few per key, and need not be all; the second step finds the others.
    chain = checked(cells.where(c("_node").isNotNull())
                    .select(c("_node").alias("a"), c("_n").alias("na"), c("node").alias("b"), c("n").alias("nb")))
    if given is not None:
        chain = chain.unionByName(checked(given, least=False))
    roots = settle(components(chain))
    found = cells.select("key", "node", "n", "at").join(
        sized(roots.select(c("fp").alias("_fp"), "root")), c("node") == c("_fp"), "left")
    found = found.select("key", "node", "n", "at", F.coalesce("root", "node").alias("root"))

    def apart(rows: DataFrame, depth: int) -> DataFrame:
        """Only keys of several components, with how many nodes of other components a node of
        the key meets there on average, and how many rows it would have after a split. A large
        group that is linked already meets few."""
        rows = rows.withColumns({"_all": F.count(F.lit(1)).over(by_key),
                                 "_own": F.count(F.lit(1)).over(Window.partitionBy("key", "root"))})
        further = F.avg(c("n") - F.ceil(c("n") * percent / 100) + depth - c("at")).over(by_key)
        rows = rows.withColumns({"_met": F.avg(c("_all") - c("_own")).over(by_key), "_more": further})
        return rows.where("_met > 0").drop("_all", "_own")

    def split(rows: DataFrame, depth: int) -> DataFrame:
        """Crowded keys again, each by one more shingle that comes later in the order."""
        # A node's crowded keys are some of its own first shingles.
        asked = rows.groupBy("node", "root").agg(F.collect_list(F.struct("key", "at")).alias("keys"))
        asked = asked.select(c("node").alias("_w"), "root", c("keys.key").alias("keys"), c("keys.at").alias("places"))
        wanted = texts.join(sized(settle(asked)), c("node") == c("_w")).select("node", "text", "root", "keys", "places")
        names = ["key", "node", "n", "at", "root"]

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[int] = set()
            for batch in batches:
                out = []
                for name, text, root, keys, places in zip(batch["node"].tolist(), batch["text"], batch["root"].tolist(),
                                                          batch["keys"], batch["places"]):
                    if name in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(name)
                    own = ordered(shingles(text, shingle), sent.value)
                    first = own[:prefix(len(own), percent, depth)].astype("<i8")
                    marks = [x.tobytes() for x in first]
                    if len(own) < depth:  # similar sets this small are equal: they end alike
                        marks.append(b"end")
                    for key, at in zip(keys.tolist(), places.tolist()):
                        head = key.to_bytes(8, "little", signed=True)
                        for place in range(at + 1, len(marks)):
                            longer = xxhash.xxh64_intdigest(head + marks[place], SEED)
                            out.append((longer - (1 << 64) if longer >> 63 else longer, name, len(own), place, root))
                        if len(out) > 20_000:  # a long text may have thousands of keys
                            yield pd.DataFrame(out, columns=names)
                            out = []
                if out:
                    yield pd.DataFrame(out, columns=names)

        dealt = wanted.mapInPandas(lean(deal), "key bigint, node bigint, n int, at int, root bigint")
        return marked(stored(apart(dealt.dropDuplicates(["key", "node"]), depth), "near-sets-split"))

    def early(side: str, depth: int):
        """Whether enough shingles follow the last of the ``depth`` that the key stands for."""
        return (c("l.n") + c("r.n")) * percent <= (c(f"{side}.n") + depth - 1 - c(f"{side}.at")) * (100 + percent)

    def alike(left: dict, right: dict):
        """What bitmaps allow: no more differing places than members of one set alone."""
        apart_ = sum((F.bit_count(left[w].bitwiseXOR(right[w])) for w in BITMAP), F.lit(0))
        n = left["n"] + right["n"]
        return apart_ <= n - 2 * F.ceil(n * percent / (100 + percent))

    def bitmaps(rows: DataFrame) -> DataFrame:
        wanted = sized(settle(rows.select(c("node").alias("_w")).distinct()))

        def one(name: int, own: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"_b": [name], **dict(zip(BITMAP, bitmap(own).reshape(-1, 1)))})

        got = texts.join(wanted, c("node") == c("_w"), "left_semi").mapInPandas(
            _once(shingle, one), ", ".join(f"{x} bigint" for x in ["_b", *BITMAP]))
        return sized(stored(got.dropDuplicates(["_b"]), "near-sets-bits"))

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(bits, c("node") == c("_b")).drop("_b")

    found = stored(apart(found, 1), "near-sets-apart")
    bits, more = bitmaps(found), []
    found = marked(found)
    for turn in range(ROUNDS):
        mixed = by_key.orderBy(F.xxhash64("node", F.lit(turn)), "node")
        side = F.struct("node", "n", "at", "root", *BITMAP)
        near = found.where(c("_met") > FEW).select(
            side.alias("l"), F.array(*[F.lead(side, i).over(mixed) for i in range(1, NEXT + 1)]).alias("r"))
        near = near.select("l", F.explode("r").alias("r"))
        near = near.where(c("r").isNotNull() & (c("l.root") != c("r.root")) & fits(c("l.n"), c("r.n")) & early("l", 1) & early("r", 1)
                          & alike(*[{x: c(f"{e}.{x}") for x in ["n", *BITMAP]} for e in "lr"]))
        first = c("l.node") < c("r.node")
        near = near.select(*[F.when(first, c(f"l.{x}")).otherwise(c(f"r.{x}")).alias(y) for x, y in (("node", "a"), ("n", "na"))],
                           *[F.when(first, c(f"r.{x}")).otherwise(c(f"l.{x}")).alias(y) for x, y in (("node", "b"), ("n", "nb"))])
        new = checked(near, least=False)
        if new.isEmpty():
            break
        more.append(new)
        # Links between components, named by their roots, join these to larger ones.
        at = found.select("node", "root").distinct()
        ends = [at.select(c("node").alias(x), c("root").alias(f"root_{x}")) for x in "ab"]
        joined = components(new.join(ends[0], "a").join(ends[1], "b").select(c("root_a").alias("a"), c("root_b").alias("b")))
        found = found.join(sized(joined.select(c("fp").alias("_fp"), c("root").alias("_to"))), c("root") == c("_fp"), "left")
        found = found.withColumn("root", F.coalesce("_to", "root")).select("key", "node", "n", "at", "root", *BITMAP)
        found = stored(apart(found, 1), "near-sets-apart")

    pairs = []
    for depth in range(2, DEPTH + 2):
        large = (c("_met") > CROWD) & (c("_met") > SPLIT_COST * c("_more")) if depth <= DEPTH else F.lit(False)
        crowded, few = found.where(large), found.where(~large)
        left, right = few.alias("l"), few.alias("r")
        pairs.append(left.join(right, (c("l.key") == c("r.key")) & (c("l.node") < c("r.node")) & (c("l.root") != c("r.root"))
                               & fits(c("l.n"), c("r.n")) & early("l", depth - 1) & early("r", depth - 1)
                               & alike(*[{x: c(f"{e}.{x}") for x in ["n", *BITMAP]} for e in "lr"]))
                     .select(c("l.node").alias("a"), c("l.n").alias("na"), c("r.node").alias("b"), c("r.n").alias("nb")))
        if depth > DEPTH or crowded.isEmpty():
            break
        found = split(crowded, depth)
    shared = pairs[0]
    for p in pairs[1:]:
        shared = shared.unionByName(p)
    out = chain
    for links_ in [*more, checked(shared, least=False)]:
        out = out.unionByName(links_)
    return out
