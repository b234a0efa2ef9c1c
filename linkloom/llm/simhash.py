"""Near-duplicates by SimHash fingerprints and BK-trees.

1. Every whole text gets a 64-bit fingerprint: a bit is set if more than half of its
   three-word shingles have it set in their XXH64.
2. Equal fingerprints are one node. Two fingerprints that differ in at most ``RADIUS`` = 3
   bits agree on one of four 16-bit blocks, and, with that block put aside, on one of four
   12-bit blocks of the rest. So every near pair meets in one of 16 shards whose key is a pair
   of such blocks (28 bits): no pair is lost, and shards stay small as the input grows.
3. In a shard, a BK-tree keyed by integer Hamming distance to the parent is searched along
   the edges within the radius only. A shard over ``MAX_TREE`` nodes is cut into trees; each
   tree is sent to the cells where the shard's other members query it, so a cell holds two
   trees' members at most, and no pair is lost. The trees go through the shuffle rather
   than through a broadcast, since the trees of all shards together grow with the data.
4. A cell emits a spanning forest of its links (fewer edges than members), never all pairs.
   Components follow by repeated minimum over neighbours with pointer jumping, on distinct
   fingerprints only, checkpointed each round.

Defined results: null or blank text has fingerprint zero and is linked like any other; a null
id gets a component like any other and is never chosen as a component's id unless all are
null; repeated rows are copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from linkloom.llm import near_sets
from linkloom.llm.common import lean, partitions, settle, sized, small_batches, stored, whole_row, with_row

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Nodes of one BK-tree at most.
MAX_TREE = 2048
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    starts = [0, *(ends[:len(words) - k] + 1).tolist()]
    stops = ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set."""
    half, sums = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096].view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.where(2 * sums > half, np.uint64(1), np.uint64(0)) << _BITS).sum(dtype=np.uint64))


def _fingerprint_batch(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


#: The 64 bits as a BIGINT. Non-deterministic only so that it is evaluated once per row.
fingerprints = F.pandas_udf(_fingerprint_batch, LongType()).asNondeterministic()


def hex64(fp):
    """16 lower-case hex digits of a BIGINT's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class BKTree:
    """Distinct fingerprints; a child hangs at its Hamming distance from the parent."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in range(len(values))]
        plain = values.tolist()
        for i in range(1, len(plain)):
            at, x = 0, plain[i]
            while True:
                d = (plain[at] ^ x).bit_count()
                child = self.children[at].get(d)
                if child is None:
                    self.children[at][d] = i
                    break
                at = child

    def near(self, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
        """(node, indexes of the queries within the radius); all queries walk the tree
        together, and each follows only the edges its distance allows."""
        if not len(self.values):
            return
        todo = [(0, np.arange(len(queries)))]
        while todo:
            at, who = todo.pop()
            d = np.bitwise_count(queries[who] ^ self.values[at])
            hit = who[d <= radius]
            if len(hit):
                yield at, hit
            for edge, child in self.children[at].items():
                go = who[(d >= edge - radius) & (d <= edge + radius)]
                if len(go):
                    todo.append((child, go))


def forest(trees: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links within the radius between the members of one cell, as a spanning forest.

    One array: all links inside it. Two: only those across, the inner ones being found elsewhere.
    """
    values = np.concatenate(trees)
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    shift = len(trees[0]) if len(trees) == 2 else 0
    edges = []
    for node, hits in BKTree(trees[0]).near(trees[-1]):
        a = root(node)
        for i in hits.tolist():
            b = root(i + shift)
            if a != b:
                parent[b] = a
                edges.append((node, i + shift))
    return [(int(values[i]), int(values[j])) for i, j in edges]


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (shard, left, right, side): one cell after the other."""
    left: list[pd.DataFrame] = []

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        key = cells[["shard", "left", "right"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        stops = np.r_[starts[1:], len(key)]
        fp, chunk = cells["fp"].to_numpy().view(np.uint64), cells["chunk"].to_numpy()
        out = []
        for a, b in zip(starts[stops - starts > 1], stops[stops - starts > 1]):
            i, j = key[a, 1], key[a, 2]
            if b - a == 2:
                x, y = int(fp[a]), int(fp[b - 1])
                if (x ^ y).bit_count() <= RADIUS and (i == j or chunk[a] != chunk[b - 1]):
                    out.append((x, y))
                continue
            mine = fp[a:b]
            out += forest([mine] if i == j else [mine[chunk[a:b] == i], mine[chunk[a:b] == j]])
        edges = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    for batch in batches:
        if not len(batch):
            continue
        left.append(batch)
        # The last cell may go on in the next batch; a cell has 2 * MAX_TREE rows or so.
        rows = pd.concat(left, ignore_index=True)
        last = rows[["shard", "left", "right"]].iloc[-1]
        open_ = ((rows["shard"] == last["shard"]) & (rows["left"] == last["left"])
                 & (rows["right"] == last["right"])).to_numpy()
        cut = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
        if cut:
            yield solve(rows.iloc[:cut])
        left = [rows.iloc[cut:]]
    if left:
        yield solve(pd.concat(left, ignore_index=True))


def _shards(fp):
    """The 16 shard keys of a fingerprint: a 16-bit block and a 12-bit block of the rest."""
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << 16 * i) - 1))
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * i + 16), 16 * i) if i < 3 else F.lit(0)
        rest = low.bitwiseOR(high)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((i * 4 + j) << 28).cast("long").bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*keys)


def links(nodes: DataFrame, max_tree: int = MAX_TREE) -> DataFrame:
    """(a, b): fingerprints at 3 bits or fewer, enough of them to connect all that are
    connected. ``nodes`` has distinct non-null ``fp``."""
    small_batches(nodes.sparkSession, 20_000)
    rows = nodes.select("fp", F.explode(_shards(F.col("fp"))).alias("shard"))
    # Members per shard; only shards too large for one tree are listed.
    large = (rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_tree)
             .select(F.col("shard").alias("_s"), F.ceil(F.col("n") / max_tree).cast("int").alias("cut")))
    rows = rows.join(large, F.col("shard") == F.col("_s"), "left")
    cut = F.coalesce("cut", F.lit(1))
    rows = rows.select("fp", "shard", cut.alias("cut"),
                       F.when(cut == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp", F.lit(7)), cut)).cast("int").alias("chunk"))
    rows = rows.select("fp", "shard", "chunk", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other"))
    rows = rows.select("fp", "shard", "chunk", F.least("chunk", "other").alias("left"),
                       F.greatest("chunk", "other").alias("right"))
    cells = rows.repartition("shard", "left", "right").sortWithinPartitions("shard", "left", "right")
    return cells.mapInPandas(lean(_links), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint that each one in ``edges`` is connected with.

    Each round takes the minimum over a node's neighbours and then the root's own root, until
    nothing changes; a chain of n nodes takes O(log n) rounds in practice.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b"))
    state = settle(both.groupBy("a").agg(F.min("b").alias("b"))
                   .select(F.col("a").alias("fp"), F.least("a", "b").alias("root")))
    while True:
        here = state.select(F.col("fp").alias("_fp"), F.col("root").alias("_root"))
        # What neighbours know, handed to a node and to its root.
        heard = both.join(here, F.col("b") == F.col("_fp")).groupBy(F.col("a").alias("fp")).agg(F.min("_root").alias("heard"))
        told = (state.join(heard, "fp").groupBy(F.col("root").alias("fp")).agg(F.min("heard").alias("heard")))
        better = heard.union(told).groupBy("fp").agg(F.min("heard").alias("heard"))
        moved = (state.join(better, "fp", "left")
                 .select("fp", F.col("root").alias("was"), F.least("root", "heard").alias("root")))
        jump = moved.select(F.col("fp").alias("_at"), F.col("root").alias("_next"))
        after = settle(moved.join(jump, F.col("root") == F.col("_at"), "left")
                       .select("fp", "was", F.least("root", F.coalesce("_next", "root")).alias("root")))
        if after.where("was <> root").isEmpty():
            return after.select("fp", "root")
        state = after.select("fp", "root")


def candidates(docs: DataFrame, text: str, shingle: int, texts: DataFrame | None = None) -> DataFrame:
    """(a, na, b, nb): nodes of ``near_sets`` and the sizes of their sets, whose fingerprints lie
    within the radius, enough of them to connect all that are connected. The fingerprint is that
    of the set of shingles; nodes with one fingerprint hang at its smallest node.
    ``texts`` are the ``near_sets.named_texts`` of ``docs``, if they are there already."""
    texts = near_sets.named_texts(docs, text) if texts is None else texts

    def emit(name: int, own: np.ndarray) -> pd.DataFrame:
        fp = np.array([majority(own.astype("<i8").view("<u8"))], dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"node": [name], "n": [len(own)], "fp": fp})

    prints = stored(texts.mapInPandas(near_sets._once(shingle, emit), "node bigint, n int, fp bigint")
                    .dropDuplicates(["node"]), "prints")
    firsts = settle(prints.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")))
    few = sized(firsts.select(F.col("fp").alias("_fp"), "first"))
    alike = (prints.join(few, (F.col("fp") == F.col("_fp")) & (F.col("node") != F.col("first.node")))
             .select(F.col("first.node").alias("a"), F.col("first.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb")))
    found = settle(links(firsts.select("fp")))
    for end in "ab":
        found = found.join(few.select(F.col("_fp").alias(f"_{end}"), F.col("first").alias(f"_first_{end}")), F.col(end) == F.col(f"_{end}"))
    near = found.select(*[F.col(f"_first_{x}.{y}").alias(z) for x, y, z in (("a", "node", "a"), ("a", "n", "na"), ("b", "node", "b"), ("b", "n", "nb"))])
    out = settle(alike.unionByName(near))
    small_batches(docs.sparkSession)
    return out


def _named(percent: int | None, shingle: int):
    """What names a node: the fingerprint, or the hash of the words."""
    if percent is None and shingle != SHINGLE:
        raise ValueError(f"fingerprints have shingles of {SHINGLE} words")
    return fingerprints if percent is None else near_sets.nodes


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                    percent: int | None = 80) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row: the component's smallest fingerprint
    and its smallest doc_id.

    With ``percent``, texts are linked if their sets of ``shingle`` words have that Jaccard
    similarity; ``fp`` is then the hash of the text's words. Fingerprints of the sets are searched by
    the BK-trees, and what they link is checked exactly. At such a distance fingerprints may also lie up to
    a dozen bits and more apart, where no shard keys reach all pairs; between the components that
    the trees found, ``near_sets`` finds all the others.
    Without it, texts are linked if their fingerprints of three-word shingles lie three bits
    apart at most.
    """
    small_batches(docs.sparkSession)
    named = _named(percent, shingle)
    rows = settle(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), named(F.col(f"`{text}`").cast("string")).alias("fp")))
    firsts = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    share = firsts.agg(F.sum("n")).first()[0] or 0
    if percent is None:
        found = links(firsts.select("fp"))
    else:
        texts = near_sets.named_texts(docs, text)
        found = near_sets.links(docs, text, shingle, percent, given=candidates(docs, text, shingle, texts), texts=texts)
    roots = components(found)
    grown = firsts.join(roots, "fp").groupBy("root").agg(F.min("first").alias("smallest"))
    linked = roots.join(grown, "root").select(F.col("fp").alias("_fp"), "root", "smallest")
    known = settle(firsts.join(linked, F.col("fp") == F.col("_fp"), "left")
             .select(F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("root"),
                     F.coalesce("smallest", "first").alias("component_id"), "n"))
    # A fingerprint may have a third of all rows. Those with more than a quarter of what a
    # partition holds are few, four per partition at most, and are broadcast.
    hot = F.col("n") * 4 * partitions(docs.sparkSession) > share
    columns = ["doc_id", "fp", "root", "component_id"]
    few = F.broadcast(known.where(hot))
    return (rows.join(few, F.col("fp") == F.col("_fp")).select(*columns)
            .unionByName(rows.join(few, F.col("fp") == F.col("_fp"), "left_anti")
                         .join(known.where(~hot), F.col("fp") == F.col("_fp")).select(*columns)))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                percent: int | None = 80) -> DataFrame:
    """One whole row of ``docs`` for each component: the row of its smallest
    (doc_id, fingerprint), a null doc_id after all others."""
    found = near_duplicates(docs, doc_id, text, shingle, percent)
    keep = (found.groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("k"))
            .select(F.col("k.doc_id").alias("_kid"), F.col("k.fp").alias("_kfp")))
    small_batches(docs.sparkSession)
    rows = docs.select(whole_row(docs).alias("_row"), F.col(f"`{doc_id}`").alias("_id"),
                       _named(percent, shingle)(F.col(f"`{text}`").cast("string")).alias("_fp"))
    # Null-safe equality as plain columns, so that the last step needs no shuffle of its own.
    id_type = rows.schema["_id"].dataType
    null_safe = lambda x: [x.isNull(), F.coalesce(x, F.lit(0).cast(id_type))]
    rows = rows.withColumns(dict(zip(("_a", "_b"), null_safe(F.col("_id")))))
    keep = keep.select(*[x.alias(n) for n, x in zip(("_a", "_b"), null_safe(F.col("_kid")))], F.col("_kfp").alias("_fp"))
    kept = rows.join(keep, ["_a", "_b", "_fp"], "left_semi")
    return with_row(kept.dropDuplicates(["_a", "_b", "_fp"]), "_row", [], [])
