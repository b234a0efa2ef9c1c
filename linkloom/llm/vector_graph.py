"""Approximate nearest neighbours by inner product: robust-pruned directed graphs over shards.

1. Equal vectors are one point, which keeps the smallest ``k + 1`` ids of its rows; copies are
   cut to that many in each map task, so a vector of a third of all rows is no hot key.
2. A point's shard follows from its hash. The graph of a shard is built over the directions of
   its points, of which distances and inner products have one order (over points as they are, a
   few long ones would take all edges: recall 0.77 instead of 0.98 where norms lie between 0.5
   and 1.5). They enter it in batches that double up to ``BATCH``: a greedy search from the centre
   proposes a point's neighbours, of which relaxed distance pruning keeps the diverse ones (a
   candidate goes if it is ``ALPHA`` times nearer to a kept one than to the point); edges also
   lead back, and a point with too many is pruned the same way. The graph is a table, one row
   per point, so a lost executor repeats a shard at most.
3. Every query searches every shard with a beam, by the inner products themselves; the shard's graph is read by a task once, the
   queries stream past it. Shards' results meet per query, ``k + 1`` points of each.

All rows are indexed, in shards of ``SHARD_ROWS`` points whatever the table's size; a task holds
one shard and one batch of queries. Scores are worked out again on the original vectors in
double precision, summed in the order of the components.

Defined results: vectors that are null, empty or zero, or that hold null or non-finite
components, are neither indexed nor searched for. Vectors of another length are compared with those of
their own length only. A repeated row is a point of its own in the results, and a query of its
own; a query's own row is left out once. Ids may repeat or be null (a null id ranks last
among equals). Ties go to the smaller id. An empty table has no results. Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import stored

#: Points of a shard, out-edges of a point, the factor of relaxed pruning, points inserted at once.
SHARD_ROWS, DEGREE, ALPHA, BATCH = 8192, 32, 1.2, 512
#: Places of the beam when the graph is built, and when it is searched.
BUILD_BEAM, BEAM = 64, 192
#: Points of the beam that are expanded in a step; queries that are walked at once.
WIDTH, TOGETHER = 8, 512
#: Queries of a block: a shard's graph is read once for each block.
BLOCK = 16_384
#: Partitions of the search at most; beyond, a task takes several shards one after the other.
MOST_PARTS = 20_000
_NO_ID = 2 ** 63 - 1


# ---------------------------------------------------------------- one shard

def beam_search(base: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray,
                beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest points found for each query (-1 where there are fewer), and their
    inner products, nearest first. ``edges`` holds -1 behind a point's last edge."""
    many, n = len(queries), len(base)
    found = np.full((many, beam), -1, dtype=np.int32)
    near = np.full((many, beam), -np.inf, dtype=np.float32)
    open_ = np.zeros((many, beam), dtype=bool)
    found[:, 0], near[:, 0], open_[:, 0] = start, queries @ base[start], True
    seen = np.zeros((many, n), dtype=bool)
    seen[:, start] = True
    claim = np.zeros((many, n), dtype=np.int32)
    while True:
        pick = open_ & (np.cumsum(open_, axis=1, dtype=np.int32) <= WIDTH)
        rows, cols = np.nonzero(pick)
        if not len(rows):
            return found, near
        open_[pick] = False
        nodes = edges[found[rows, cols]]
        rows = np.repeat(rows, nodes.shape[1])
        nodes = nodes.ravel()
        fresh = nodes >= 0
        rows, nodes = rows[fresh], nodes[fresh]
        fresh = ~seen[rows, nodes]
        rows, nodes = rows[fresh], nodes[fresh]
        # Two points expanded at once may lead to the same one: the last to claim it keeps it.
        order = np.arange(len(rows), dtype=np.int32)
        claim[rows, nodes] = order
        fresh = claim[rows, nodes] == order
        rows, nodes = rows[fresh], nodes[fresh]
        if not len(rows):
            continue
        seen[rows, nodes] = True
        value = np.einsum("ij,ij->i", queries[rows], base[nodes])
        worth = value > near[rows, -1]
        rows, nodes, value = rows[worth], nodes[worth], value[worth]
        if not len(rows):
            continue
        counts = np.bincount(rows, minlength=many)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        touched = np.flatnonzero(counts)
        row_of = np.zeros(many, dtype=np.int64)
        row_of[touched] = np.arange(len(touched))
        wide = beam + int(counts.max())
        ids = np.full((len(touched), wide), -1, dtype=np.int32)
        values = np.full((len(touched), wide), -np.inf, dtype=np.float32)
        still = np.zeros((len(touched), wide), dtype=bool)
        ids[:, :beam], values[:, :beam], still[:, :beam] = found[touched], near[touched], open_[touched]
        at = row_of[rows]
        ids[at, beam + place], values[at, beam + place], still[at, beam + place] = nodes, value, True
        best = np.argsort(-values, axis=1, kind="stable")[:, :beam]
        found[touched] = np.take_along_axis(ids, best, 1)
        near[touched] = np.take_along_axis(values, best, 1)
        open_[touched] = np.take_along_axis(still, best, 1)


def robust_prune(base: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each point out of its candidates (-1: none), which
    are distinct; the nearest is always kept. All vectors have length one."""
    many, wide = candidates.shape
    own = base[points]
    vectors = base[np.maximum(candidates, 0)]
    value = np.einsum("ij,ikj->ik", own, vectors)
    valid = (candidates >= 0) & (candidates != points[:, None])
    order = np.argsort(np.where(valid, -value, np.inf), axis=1, kind="stable")
    candidates, value, valid = (np.take_along_axis(x, order, 1) for x in (candidates, value, valid))
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    between = 2 * (1 - vectors @ vectors.transpose(0, 2, 1))
    apart = 2 * (1 - value)
    kept = np.full((many, degree), -1, dtype=np.int32)
    each = np.arange(many)
    for i in range(degree):
        first = valid.argmax(axis=1)
        some = valid[each, first]
        if not some.any():
            break
        kept[:, i] = np.where(some, candidates[each, first], -1)
        valid &= alpha * alpha * between[each, first] > apart
        valid[each, first] = False
    return kept


def build_graph(vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA,
                beam: int = BUILD_BEAM) -> tuple[np.ndarray, int]:
    """(edges, start) over distinct vectors, whose order settles all ties."""
    base = directions(vectors)
    n = len(base)
    start = int(np.argmax(base @ base.mean(axis=0)))
    edges = np.full((n, degree), -1, dtype=np.int32)
    order = np.concatenate([[start], np.delete(np.arange(n), start)])
    done = 1
    while done < n:
        new = order[done:done + min(done, BATCH)]
        found, _ = beam_search(base, edges, start, base[new], beam)
        edges[new] = robust_prune(base, new, found, degree, alpha)
        source = np.repeat(new, degree)
        target = edges[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        _link_back(base, edges, source, target, degree, alpha)
        done += len(new)
    return edges, start


def _link_back(base, edges, source, target, degree, alpha) -> None:
    """Add an edge from each target to its source; a point with too many is pruned."""
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    points, first, counts = np.unique(target, return_index=True, return_counts=True)
    # Points of about the same number of new edges together, so that a hub widens only its own group.
    by = np.argsort(counts, kind="stable")
    points, first, counts = points[by], first[by], counts[by]
    at = 0
    while at < len(points):
        upto = at + 1
        while upto < len(points) and (upto - at) * (degree + int(counts[upto])) ** 2 <= 4_000_000:
            upto += 1
        p, f, k = points[at:upto], first[at:upto], counts[at:upto]
        wide = int(k.max())
        place = np.arange(wide)
        mine = np.where(place < k[:, None], source[np.minimum(f[:, None] + place, len(source) - 1)], -1)
        old = edges[p]
        # An edge that is there already is not added again.
        mine = np.where((mine[:, :, None] == old[:, None, :]).any(axis=2), -1, mine)
        both = np.concatenate([old, mine.astype(np.int32)], axis=1)
        full = (both >= 0).sum(axis=1) > degree
        if full.any():
            edges[p[full]] = robust_prune(base, p[full], both[full], degree, alpha)
        if not full.all():
            few = both[~full]
            few = np.take_along_axis(few, np.argsort(few < 0, axis=1, kind="stable"), 1)
            edges[p[~full]] = few[:, :degree]
        at = upto


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors over their largest component, in single precision; the order of products stays."""
    return (vectors / np.abs(vectors).max(initial=1e-300)).astype(np.float32)


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; none is zero."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (unit / np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]).astype(np.float32)


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    out = 0.0
    for i in range(queries.shape[-1]):
        out = out + queries[..., i] * vectors[..., i]
    return out


# ---------------------------------------------------------------- tables

def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def points(rows: DataFrame, keep: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(cell, vector, ids) of the distinct vectors, with the number of cells. ``rows`` holds
    (id, vector); ``ids`` are the smallest ``keep`` of a vector, repeated ones repeatedly."""
    c = F.col
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(c("_r") <= keep)
    found = stored(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    # Few lengths, mostly one: a row for each.
    sizes = sorted(r for r in found.groupBy(F.size("vector").alias("dim")).count().collect())
    first, cell = 0, F.lit(None).cast("int")
    for dim, n in sizes:
        shards = -(-n // shard_rows)
        cell = F.when(F.size("vector") == dim, F.lit(first) + F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).otherwise(cell)
        first += shards
    return found.select(cell.alias("cell"), "vector", "ids"), first


def _grouped(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[int, pd.DataFrame]]:
    held: list[pd.DataFrame] = []
    for batch in batches:
        for value, part in batch.groupby(key, sort=False):
            if held and held[0][key].iloc[0] != value:
                yield int(held[0][key].iloc[0]), pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield int(held[0][key].iloc[0]), pd.concat(held, ignore_index=True)


def build_index(found: DataFrame, cells: int, degree: int = DEGREE, alpha: float = ALPHA) -> DataFrame:
    """(cell, place, start, vector, ids, edges): the graphs of all shards, a row per point."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _grouped(batches, "cell"):
            edges, start = build_graph(np.array(rows["vector"].tolist(), dtype=np.float64), degree, alpha)
            rows["place"], rows["start"] = np.arange(len(rows)), start
            rows["edges"] = list(edges)
            for at in range(0, len(rows), 4096):
                yield rows.iloc[at:at + 4096]

    dealt = found.repartitionById(min(max(1, cells), MOST_PARTS), F.col("cell")).sortWithinPartitions("cell", F.xxhash64("vector"), "vector")
    kind = found.schema["vector"].dataType.simpleString()
    return stored(dealt.mapInPandas(run, f"cell int, vector {kind}, ids array<bigint>, place int, start int, edges array<int>"), "graphs")


def search_index(index: DataFrame, cells: int, queries: DataFrame, k: int, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """(row, id, score, ids): the ``k`` nearest points that each shard finds for each of
    ``queries`` (row, id, vector); ``own`` tells whether the point is the query's vector."""
    c = F.col
    total = queries.count()
    blocks = max(1, -(-total // block))
    dims = index.groupBy("cell").agg(F.min(F.size("vector")).alias("dim"))
    none = lambda x, t: F.lit(None).cast(t).alias(x)
    left = index.select("cell", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"),
                        "place", "start", "vector", "ids", "edges", none("row", "bigint"), none("id", "bigint"))
    # A row per shard, of a few bytes; each query goes to the shards of its length.
    asked = queries.join(F.broadcast(dims), F.size("vector") == c("dim"))
    right = asked.select("cell", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"),
                         none("place", "int"), none("start", "int"), "vector", none("ids", "array<bigint>"),
                         none("edges", "array<int>"), "row", "id")
    rows = (left.unionByName(right).withColumn("part", c("block") * cells + c("cell"))
            .repartitionById(min(max(1, cells * blocks), MOST_PARTS), c("part")).sortWithinPartitions("part", "kind", "place", "row"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph: list[pd.DataFrame] = []
        ready = None
        for batch in batches:
            for part, rows in batch.groupby("part", sort=False):
                points_, asked_ = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
                if len(points_):
                    if ready is not None or (graph and graph[0]["part"].iloc[0] != part):
                        graph, ready = [], None
                    graph.append(points_)
                if len(asked_) and graph:
                    if ready is None:
                        whole = pd.concat(graph, ignore_index=True)
                        vectors = np.array(whole["vector"].tolist(), dtype=np.float64)
                        ready = (vectors, scaled(vectors), np.array(whole["edges"].tolist(), dtype=np.int32).reshape(len(whole), -1),
                                 int(whole["start"].iloc[0]), whole["ids"].tolist())
                    for at in range(0, len(asked_), TOGETHER):
                        yield _answers(ready, asked_.iloc[at:at + TOGETHER], k, beam)

    return rows.mapInPandas(run, "row bigint, id bigint, score double, own boolean, ids array<bigint>")


def _answers(ready: tuple, asked: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    vectors, base, edges, start, ids = ready
    wanted = np.array(asked["vector"].tolist(), dtype=np.float64)
    # A query's length does not change its order of points.
    found, _ = beam_search(base, edges, start, directions(wanted), max(beam, k))
    score = np.where(found >= 0, exact(wanted[:, None, :], vectors[np.maximum(found, 0)]), -np.inf)
    smallest = np.array([x[0] for x in ids], dtype=np.int64)[np.maximum(found, 0)]
    order = np.lexsort((smallest, -score), axis=1)[:, :k]
    rows, cols = np.nonzero(np.take_along_axis(found, order, 1) >= 0)
    cols = order[rows, cols]
    hit = found[rows, cols]
    return pd.DataFrame({"row": asked["row"].to_numpy()[rows], "id": asked["id"].to_numpy()[rows], "score": score[rows, cols],
                         "own": (vectors[hit] == wanted[rows]).all(axis=1), "ids": [ids[h] for h in hit]})


def nearest(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
            beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of which
    ``is_query`` holds."""
    c = F.col
    plain = rows.select(F.coalesce(c(f"`{vec_id}`").cast("bigint"), F.lit(_NO_ID)).alias("id"), c(f"`{vector}`").alias("vector"),
                        F.coalesce(is_query, F.lit(False)).alias("asks")).where(valid(c("vector")))
    queries = stored(plain.where("asks").select("id", "vector").withColumn("row", F.monotonically_increasing_id()), "queries")
    found, cells = points(plain.select("id", "vector"), k + 1, shard_rows)
    hits = search_index(build_index(found, cells), cells, queries, k + 1, beam)
    by = Window.partitionBy("row")
    best = hits.withColumn("_r", F.row_number().over(by.orderBy(F.desc("score"), c("ids")[0]))).where(c("_r") <= k + 1)
    mine = F.array_position("ids", c("id")) - 1
    others = F.when(c("own"), F.filter("ids", lambda x, i: i != mine)).otherwise(c("ids"))
    flat = best.select("row", "id", "score", F.explode(others).alias("vec_id"))
    ranked = flat.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))).where(c("rank") <= k)
    real = lambda x: F.nullif(c(x), F.lit(_NO_ID))
    return ranked.select(real("id").alias("query_id"), "rank", real("vec_id").alias("vec_id"), "score")
