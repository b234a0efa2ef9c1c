"""A Merkle manifest of a dataset: a store of digest-to-children records, and membership proofs
by descent through it.

Leaves are numbered per tree (a distributed ordinal). A tree is built in segments of ``HEIGHT``
levels: the 3^HEIGHT leaves below one node meet in one task, which writes a record
(digest, children) for each inner node; the segments' tops are the next round's leaves. The
trees' own roots, in the order of the trees, are the leaves of one more tree. Every record
carries the digest of its segment's top, and records are kept once per content, so the store is
addressed by digests alone.

A request for a leaf descends from the root: the digits of its rank (base 3, the highest first)
say which child to follow, and the children not followed are collected. Requests that share a
segment share its records: they are joined by the segment top's digest, and a node's path above
a segment is worked out once, not once per leaf. Reversed, the path is the proof from the leaf
to the root.

So a table of n leaves takes ceil(log3(n) / HEIGHT) shuffles up and as many down, of digests
only; texts are read once and never moved. A source with a third of all rows is cut into segments like
any other. No task holds more than one segment (3^HEIGHT leaves) and one Arrow batch.

Defined results: null fields are encoded as ``-``; a null number or name comes first in its
order; rows with equal fields are leaves of their own, next to each other; empty and very long
texts are fields like others; an empty table has no leaf, no record and no root. Other columns
of the input, whatever their names, are not part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import sized, stored
from linkloom.operators.ordinals import with_place

FANOUT = 3
#: Levels of a segment: a task holds the 3^6 = 729 leaves below one node at once.
HEIGHT = 6

_PATH = "positions array<int>, siblings array<string>"


# ---------------------------------------------------------------- digests

def encoded(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def node_digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def levels_of(n: int) -> int:
    """How many levels lie above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def fold(leaf: Column, positions: Column, siblings: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    def up(digest: Column, level: Column) -> Column:
        left = level["positions"] * 64
        return F.sha2(F.concat(F.substr(level["siblings"], F.lit(1), left), digest,
                               F.substr(level["siblings"], left + 1)), 256)
    return F.aggregate(F.arrays_zip(positions.alias("positions"), siblings.alias("siblings")), leaf, up)


def proof_digest(siblings: Column) -> Column:
    return F.sha2(F.concat_ws("", siblings), 256)


# ---------------------------------------------------------------- up

def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each run of equal keys, from sorted batches; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*columns)):
            if key != now:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield now, pa.Table.from_batches(held)
                held, now, start = [], key, i
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield now, pa.Table.from_batches(held)


_RECORD = "tree bigint, n bigint, block bigint, top string, digest string, children array<string>"


def _builder(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records of segments, from (tree, n, block, rank, digest) sorted by tree and rank."""
        for (tree, n, block), rows in _runs(batches, "tree", "n", "block"):
            nodes, records = rows.column("digest").to_pylist(), []
            for _ in range(min(height, levels_of(n))):
                runs = [nodes[i:i + FANOUT] for i in range(0, len(nodes), FANOUT)]
                nodes = [node_digest(x) for x in runs]
                records += zip(nodes, runs)
            found = dict(records)
            size = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * size, pa.int64()), pa.array([n] * size, pa.int64()), pa.array([block] * size, pa.int64()),
                 pa.array([nodes[0]] * size), pa.array(list(found)), pa.array(list(found.values()), pa.list_(pa.string()))],
                names=["tree", "n", "block", "top", "digest", "children"])
    return run


@dataclass
class Trees:
    """``segments[i]`` holds the records of round i (counted from the leaves); ``roots`` has
    (tree, root)."""
    segments: list[DataFrame]
    roots: DataFrame
    height: int


def build(leaves: DataFrame, name: str, height: int = HEIGHT) -> Trees:
    """Trees over (tree, n, rank, digest): n leaves of a tree have the ranks 0 to n - 1."""
    c, span, segments = F.col, FANOUT ** height, []
    nodes = leaves.select("tree", "n", "rank", "digest")
    roots = nodes.where("n = 1").select("tree", c("digest").alias("root"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    nodes = nodes.withColumn("left", c("n"))
    while most > 1:
        # ``left`` counts the nodes that remain of a tree in this round.
        cells = (nodes.where("left > 1")
                 .select("tree", c("left").alias("n"), F.expr(f"rank div {span}").alias("block"), "rank", "digest"))
        rows = (cells.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
                .mapInArrow(_builder(height), _RECORD))
        segments.append(stored(rows, f"{name}-{len(segments)}"))
        nodes = (segments[-1].where("digest = top")
                 .select("tree", F.expr(f"(n + {span - 1}) div {span}").alias("left"), c("block").alias("rank"), "digest"))
        roots = roots.unionByName(nodes.where("left = 1").select("tree", c("digest").alias("root")))
        most = -(-most // span)
    return Trees(segments, roots, height)


# ---------------------------------------------------------------- down

def _descender(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Follow requests through their segment: a run starts with the segment's records, the
        first of which carries the path above; the requests follow."""
        for _, rows in _runs(batches, "tree", "block"):
            kinds = rows.column("kind").to_numpy()
            first = int((kinds == 0).sum())
            head, asked = rows.slice(0, first), rows.slice(first)
            if not len(asked):
                continue
            store = dict(zip(head.column("digest").to_pylist(), head.column("children").to_pylist()))
            top = head.column("top")[0].as_py()
            above_positions = head.column("positions")[0].as_py()
            above_siblings = head.column("siblings")[0].as_py()
            levels = min(height, levels_of(head.column("n")[0].as_py()))
            digests, positions, siblings = [], [], []
            for rank in asked.column("rank").to_pylist():
                digest, own_positions, own_siblings = top, list(above_positions), list(above_siblings)
                for level in range(levels - 1, -1, -1):
                    digit, children = rank // FANOUT ** level % FANOUT, store[digest]
                    own_positions.append(digit)
                    own_siblings.append("".join(children[:digit] + children[digit + 1:]))
                    digest = children[digit]
                digests.append(digest)
                positions.append(own_positions)
                siblings.append(own_siblings)
            for at in range(0, len(asked), 256):
                part = asked.slice(at, 256).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [part.column("tree").combine_chunks(), part.column("rank").combine_chunks(), part.column("request").combine_chunks(),
                     pa.array(digests[at:at + 256]), pa.array(positions[at:at + 256], pa.list_(pa.int32())),
                     pa.array(siblings[at:at + 256], pa.list_(pa.string()))],
                    names=["tree", "rank", "request", "digest", "positions", "siblings"])
    return run


def descend(trees: Trees, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """(tree, rank, request, digest, positions, siblings) for each of ``requests``
    (tree, n, rank, request), whose ranks lie in trees of ``starts`` (tree, root, positions,
    siblings): the path so far, the root first."""
    c, span = F.col, FANOUT ** trees.height
    kind = requests.schema["request"].dataType
    nothing = F.lit(None).cast(kind).alias("request")
    whole = requests.select("tree", "n").distinct()
    # A tree of n leaves has as many segments above a leaf as the span of a segment must be multiplied to reach n.
    tops = starts.join(whole, "tree").select("tree", "n", F.lit(0).cast("bigint").alias("block"),
                                             c("root").alias("top"), "positions", "siblings")
    done = tops.where("n = 1")
    out = (requests.where("n = 1").join(done.select("tree", "top", "positions", "siblings"), "tree")
           .select("tree", "rank", "request", c("top").alias("digest"), "positions", "siblings"))
    frontier: DataFrame | None = None
    for i in range(len(trees.segments) - 1, -1, -1):
        low, high = span ** i, span ** (i + 1)
        fresh = tops.where(f"n > {low} AND n <= {high}").drop("n")
        front = fresh if frontier is None else fresh.unionByName(frontier)
        records = trees.segments[i].select("n", "top", "digest", "children").dropDuplicates(["top", "digest"])
        head = front.join(records, "top").select(
            "tree", "block", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("rank"), nothing,
            "n", "top", "digest", "children",
            # The path is needed once per segment: the record of the top carries it.
            F.when(c("digest") == c("top"), c("positions")).alias("positions"),
            F.when(c("digest") == c("top"), c("siblings")).alias("siblings"), (c("digest") != c("top")).alias("inner"))
        asked = requests.where(f"n > {low}")
        if i:
            asked = asked.select("tree", F.expr(f"rank div {low}").alias("rank")).distinct().select("tree", "rank", nothing)
        asked = asked.select("tree", F.expr(f"rank div {span}").alias("block"), F.lit(1).alias("kind"), "rank", "request",
                             F.lit(None).cast("bigint").alias("n"),
                             *[F.lit(None).cast(t).alias(x) for x, t in
                               (("top", "string"), ("digest", "string"), ("children", "array<string>"),
                                ("positions", "array<int>"), ("siblings", "array<string>"), ("inner", "boolean"))])
        rows = head.unionByName(asked).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "inner", "rank")
        found = rows.mapInArrow(_descender(trees.height), f"tree bigint, rank bigint, request {kind.simpleString()}, digest string, {_PATH}")
        if i:
            found = stored(found, f"frontier-{i}")
            frontier = found.select("tree", c("rank").alias("block"), c("digest").alias("top"), "positions", "siblings")
        else:
            out = out.unionByName(found)
    return out


# ---------------------------------------------------------------- manifests

@dataclass
class Manifest:
    """``leaves``: (tree, n, rank, digest, and what the input had beside its key); ``groups``:
    (group, n, tree, root); the trees of the groups and the tree over them; ``root``."""
    leaves: DataFrame
    groups: DataFrame
    inner: Trees
    outer: Trees
    root: str | None


def manifest(rows: DataFrame, group: str, order: str, digest: str, height: int = HEIGHT) -> Manifest:
    """A tree of ``digest`` per value of ``group``, with leaves by ``order`` and then by digest;
    the trees by group (nulls first, strings bytewise)."""
    c = F.col
    rows = stored(rows, "leaves")
    # Equal leaves are spread by their place in the file, so that none is too many for a partition.
    placed = stored(with_place(rows.withColumn("_spread", F.monotonically_increasing_id()), [order, digest, "_spread"],
                               [group], "rank").drop("_spread"), "placed")
    groups = placed.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    groups = stored(with_place(groups, [group], None, "tree"), "groups")
    right = groups.select("tree", "n", c(group).alias("_group"))
    leaves = placed.join(sized(right), c(group).eqNullSafe(c("_group"))).drop("_group")
    leaves = leaves.withColumnRenamed(digest, "digest") if digest != "digest" else leaves
    inner = build(leaves, "records", height)
    roots = stored(inner.roots, "roots")
    groups = groups.join(roots, "tree")
    total = groups.count()
    ranks = groups.select(F.lit(0).cast("bigint").alias("tree"), F.lit(total).cast("bigint").alias("n"),
                          c("tree").alias("rank"), c("root").alias("digest"))
    outer = build(ranks, "records-of-roots", height)
    root = outer.roots.first()
    return Manifest(leaves, groups, inner, outer, None if root is None else root["root"])


def prove(made: Manifest, requests: DataFrame) -> DataFrame:
    """(request, digest, subroot, positions, siblings) for ``requests`` (tree, n, rank, request).

    ``positions`` and ``siblings`` go from the leaf to the root: the place of the node among
    its run, and the run's other digests, joined from left to right.
    """
    c = F.col
    nothing = F.array().cast("array<int>"), F.array().cast("array<string>")
    groups = made.groups
    over = groups.select(F.lit(0).cast("bigint").alias("tree"), F.lit(groups.count()).cast("bigint").alias("n"),
                         c("tree").alias("rank"), F.struct("tree", "root").alias("request"))
    top = made.outer.roots.select("tree", "root", nothing[0].alias("positions"), nothing[1].alias("siblings"))
    starts = descend(made.outer, top, over).select(
        c("request")["tree"].alias("tree"), c("digest").alias("root"), "positions", "siblings")
    starts = stored(starts, "starts")
    found = descend(made.inner, starts, requests)
    roots = starts.select(c("tree").alias("_tree"), c("root").alias("subroot"))
    return found.join(sized(roots), c("tree") == c("_tree")).select(
        "request", "digest", "subroot", F.reverse("positions").alias("positions"), F.reverse("siblings").alias("siblings"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def verify(docs: DataFrame, tampered: Column, changed: Column, height: int = HEIGHT) -> DataFrame:
    """A manifest of ``docs``, and each document held against it: where ``tampered`` is true the
    text is replaced by ``changed`` before its proof is folded.

    (doc_id, leaf, subroot, root, positions, siblings, folded_root, verified)
    """
    c = F.col
    fields = [c(f) for f in FIELDS[:-1]]
    own = leaf_digest([*fields, c("text")])
    other = leaf_digest([*fields, changed])
    is_tampered = F.coalesce(tampered, F.lit(False))
    rows = docs.select("doc_id", "source", own.alias("digest"), F.when(is_tampered, other).alias("other"))
    made = manifest(rows, "source", "doc_id", "digest", height)
    requests = made.leaves.select("tree", "n", "rank", F.struct("doc_id", "digest", "other").alias("request"))
    r = c("request")
    found = prove(made, requests).withColumn("root", F.lit(made.root))
    folded = fold(F.coalesce(r["other"], r["digest"]), c("positions"), c("siblings"))
    return (found.select(r["doc_id"].alias("doc_id"), c("digest").alias("leaf"), "subroot", "root", "positions", "siblings",
                         folded.alias("folded_root"))
            .withColumn("verified", c("folded_root") == c("root")))
