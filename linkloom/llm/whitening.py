"""Whitening of embeddings, with the components found by contour integration (FEAST).

1. Entries become whole numbers; their sums, and the sums of their centred products, are exact
   and merge by addition, so the covariance is the same whatever the partitions.
2. Inertia counts (the signs of a block LDL' of V - s) say how many eigenvalues lie above each
   of many shifts at once. They find a cut below the last component wanted and slice what lies
   above it; every slice's number of eigenvalues is known before any is computed.
3. For each slice the rational filter sum_j w_j (z_j - V)^-1 Q over a circle's nodes maps a
   block of vectors onto the slice's eigenspace. All (slice, node) solves are tasks of one job.
   Rayleigh-Ritz extracts the pairs; the filter is applied again until residuals are at
   the level of rounding and each slice holds as many pairs as its inertia says.
4. Vectors are read a third time, projected and scaled.

The driver and each task hold a few matrices of dimension x dimension, never a function of the
number of vectors.

Defined results: a vector that is null, empty or holds a null or non-finite entry is dropped, and
so is one with an entry beyond 2^52, which has no place among whole numbers. All vectors
must have one length: the most frequent (of equals the longest); others are dropped. Repeated
rows count each time; a null id stays null. Equal eigenvalues may be cut anywhere. Components
whose eigenvalue is below 1e-10 of the trace are noise and left out: so there may be fewer, and
with one distinct vector, or none, there are no rows. ``deviation`` is null where it
does not fit into a long. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import stored

SCALE, SHIFT = 1024, 100_000
#: Eigenvalues below this share of the trace are taken for rounding.
NOISE = 1e-10
#: Shifts whose inertia one job counts, nodes of a half circle, and rounds of the filter at most.
SHIFTS, NODES, ROUNDS = 32, 16, 40
_LIMIT = float(2 ** 52)


# ---------------------------------------------------------------- figures

@dataclass
class Figures:
    """``centre`` is the rounded mean of a dimension, ``rest`` the sum of what it leaves over."""
    n: int
    centre: np.ndarray
    rest: np.ndarray
    covariance: np.ndarray


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(_LIMIT)), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def whole(vectors: pd.Series) -> np.ndarray:
    """Rows of whole numbers."""
    return np.floor(SCALE * np.array(vectors.tolist(), dtype=np.float64)).astype(np.int64) + SHIFT


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of whole numbers: by floating point where all sums are exact there."""
    top = int(np.abs(y).max(initial=0))
    if top * top * max(1, len(y)) < 2 ** 53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64)
    z = y.astype(object)
    return z.T @ z


def figures(rows: DataFrame) -> Figures | None:
    """Over (vector) rows of one length; None if there are none."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for batch in batches:
            if len(batch):
                x = whole(batch["vector"])
                n, total = n + len(x), x.astype(object).sum(axis=0) + (0 if total is None else total)
        if n:
            yield pd.DataFrame({"i": np.arange(len(total)), "n": n, "s": [str(t) for t in total]})

    added = (rows.mapInPandas(sums, "i int, n bigint, s string")
             .groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
    got = sorted(added.collect())  # a row per dimension
    if not got:
        return None
    n, total = got[0]["n"], [int(r["s"]) for r in got]
    centre = np.array([(2 * t + n) // (2 * n) for t in total], dtype=np.int64)
    rest = [t - n * int(a) for t, a in zip(total, centre)]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                own = _products(whole(batch["vector"]) - centre).astype(object)
                total = own if total is None else total + own
        if total is not None:
            d = len(total)
            yield pd.DataFrame({"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "s": [str(t) for t in total.ravel()]})

    both = (rows.mapInPandas(products, "i int, j int, s string").where("i <= j")
            .groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
    d = len(centre)
    covariance = np.zeros((d, d))
    for r in both.collect():  # a row per pair of dimensions
        covariance[r.i, r.j] = covariance[r.j, r.i] = float(Fraction(n * int(r.s) - rest[r.i] * rest[r.j], n * n))
    return Figures(n, centre, np.array(rest, dtype=np.int64), covariance)


# ---------------------------------------------------------------- eigenpairs

def above_zero(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive, by LDL' with pivots of one or
    two rows (a pivot of two has one positive eigenvalue)."""
    a, found, bound = a.copy(), 0, (1 + 17 ** 0.5) / 8
    while len(a):
        size = np.abs(a)
        i = int(np.argmax(np.diag(size)))
        one = size[i, i]
        np.fill_diagonal(size, 0)
        r, s = divmod(int(np.argmax(size)), len(a))
        if one == 0 and size[r, s] == 0:
            break
        pick = [i] if one >= bound * size[r, s] else [r, s]
        found += int(a[i, i] > 0) if len(pick) == 1 else 1
        left = np.delete(np.arange(len(a)), pick)
        across = a[np.ix_(left, pick)]
        a = a[np.ix_(left, left)] - across @ np.linalg.solve(a[np.ix_(pick, pick)], across.T)
        a = (a + a.T) / 2
    return found


def _counts(spark: SparkSession, shared, shifts: list[float]) -> list[int]:
    """The number of eigenvalues above each shift; a task each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = shared.value
            batch["above"] = [above_zero(v - s * np.eye(len(v))) for s in batch["shift"]]
            yield batch[["place", "above"]]

    rows = spark.createDataFrame(list(enumerate(map(float, shifts))), "place int, shift double")
    return [r.above for r in sorted(rows.repartitionById(len(shifts), F.col("place"))
                                    .mapInPandas(run, "place int, above int").collect())]


def cut(spark: SparkSession, shared, most: int, low: float, high: float) -> tuple[float, int]:
    """A shift with ``most`` eigenvalues above it, or the fewest beyond that if they coincide
    (all above ``low`` if there are fewer); and their number."""
    above = _counts(spark, shared, [low])[0]
    floor = low
    while above > most and high - floor > 1e-13 * high:
        shifts = np.linspace(floor, high, SHIFTS + 2)[1:-1].tolist()
        counts = _counts(spark, shared, shifts)
        right = [s for s, n in zip(shifts, counts) if n == most]
        if right:
            return right[len(right) // 2], most  # the middle of those seen in the gap
        over = [(s, n) for s, n in zip(shifts, counts) if n > most]
        under = [s for s, n in zip(shifts, counts) if n < most]
        if over:
            floor, above = over[-1]
        high = under[0] if under else high
    return floor, above


def slices(spark: SparkSession, shared, low: float, high: float) -> list[tuple[float, float, int]]:
    """(from, to, number of eigenvalues), each reaching no further than to twice its lower end."""
    edges = [low]
    while edges[-1] * 2 < high:
        edges.append(edges[-1] * 2)
    edges.append(high)
    if len(edges) == 2 and high / low > 1.2:
        edges.insert(1, (low * high) ** 0.5)
    counts = _counts(spark, shared, edges)
    return [(a, b, m - n) for a, b, m, n in zip(edges, edges[1:], counts, counts[1:]) if m > n]


def _filtered(spark: SparkSession, shared, contours: list[tuple[float, float]], blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The filter of each contour (centre, radius) applied to its block; a task per node."""
    angles, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 - angles)  # the upper half circle; the lower one is its conjugate
    sent = spark.sparkContext.broadcast(blocks)
    rows = [(k * NODES + j, k, float(c), float(r), float(t), float(w))
            for k, (c, r) in enumerate(contours) for j, (t, w) in enumerate(zip(angles, weights))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v, out = shared.value, []
            for x in batch.itertuples():
                turn = np.exp(1j * x.angle)
                y = np.linalg.solve((x.centre + x.radius * turn) * np.eye(len(v)) - v, sent.value[x.block].astype(complex))
                out.append((x.place, x.block, np.real(x.radius * turn * x.weight / 2 * y).tobytes()))
            yield pd.DataFrame(out, columns=["place", "block", "part"])

    dealt = spark.createDataFrame(rows, "place int, block int, centre double, radius double, angle double, weight double")
    parts = dealt.repartitionById(len(rows), F.col("place")).mapInPandas(run, "place int, block int, part binary").collect()
    out = [np.zeros_like(b) for b in blocks]
    for p in sorted(parts):  # always added in one order
        out[p.block] += np.frombuffer(p.part).reshape(out[p.block].shape)
    sent.destroy()
    return out


def components(spark: SparkSession, covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), the largest first, ``most`` at most."""
    d, trace = len(covariance), float(np.trace(covariance))
    if trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    high = float(np.abs(covariance).sum(axis=1).max()) * (1 + 1e-9)  # no eigenvalue is above
    shared = spark.sparkContext.broadcast(covariance)
    low, total = cut(spark, shared, most, NOISE * trace, high)
    found = slices(spark, shared, low, high)
    contours = [((a + b) / 2, (b - a) / 2) for a, b, _ in found]
    rng = np.random.default_rng(1)
    blocks = [np.linalg.qr(rng.standard_normal((d, min(d, 2 * m + 16))))[0] for _, _, m in found]
    size, last = high, np.inf
    for _ in range(ROUNDS):
        kept, worst, short = [], 0.0, False
        for k, y in enumerate(_filtered(spark, shared, contours, blocks)):
            u, s, _ = np.linalg.svd(y, full_matrices=False)
            u = u[:, s > 1e-13 * s[0]]
            values, small = np.linalg.eigh(u.T @ covariance @ u)
            blocks[k] = u @ small
            a, b, m = found[k]
            inside = (values > a) & (values <= b)
            x = blocks[k][:, inside]
            residual = np.linalg.norm(covariance @ x - x * values[inside], axis=0).max(initial=0.0) / size
            worst, short = max(worst, residual), short or int(inside.sum()) != m
            kept.append(x)
        if not short and (worst < 1e-15 or (worst < 1e-12 and worst > last / 2)):
            break
        last = worst if not short else np.inf
    else:
        raise ArithmeticError(f"{total} eigenvalues are above {low}, but the filter did not settle on them")
    shared.destroy()
    # Pairs of neighbouring slices are made orthogonal together.
    q, _ = np.linalg.qr(np.hstack(kept))
    values, small = np.linalg.eigh(q.T @ covariance @ q)
    vectors = (q @ small)[:, ::-1][:, :most]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[::-1][:most], vectors * sign


# ---------------------------------------------------------------- whitening

@dataclass
class Whitening:
    figures: Figures
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return (self.values / np.trace(self.figures.covariance)).tolist()


def one_length(rows: DataFrame) -> DataFrame:
    """Rows whose ``vector`` has the most frequent length."""
    sizes = rows.groupBy(F.size("vector").alias("d")).count().collect()  # few lengths
    return rows.where(F.size("vector") == (max((r["count"], r["d"]) for r in sizes)[1] if sizes else 0))


def fit(rows: DataFrame, most: int) -> Whitening | None:
    found = figures(rows.select("vector"))
    if found is None:
        return None
    return Whitening(found, *components(rows.sparkSession, found.covariance, most))


def deviations(y: np.ndarray, figures: Figures) -> list[int | None]:
    """The sum of (n*x - S)^2 over the dimensions; with x = centre + y it is that of (n*y - rest)^2."""
    n, rest = figures.n, figures.rest
    top, far, d = int(np.abs(y).max(initial=0)), int(np.abs(rest).max(initial=0)), y.shape[1]
    if max(top, far) * top * d >= 2 ** 62:
        y, rest = y.astype(object), rest.astype(object)
    squares, mixed, own = (y * y).sum(axis=1).tolist(), (y * rest).sum(axis=1).tolist(), sum(int(r) ** 2 for r in rest)
    out = [n * n * int(s) - 2 * n * int(m) + own for s, m in zip(squares, mixed)]
    return [x if x < 2 ** 63 else None for x in out]


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """``rows`` (with a ``vector``) with their deviation and whitened components."""
    f = model.figures
    scaled = model.vectors / np.sqrt(model.values)
    rest = f.rest / f.n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                y = whole(batch.pop("vector")) - f.centre
                batch["deviation"] = pd.Series(deviations(y, f), index=batch.index, dtype="Int64")
                batch["whitened"] = list((y - rest) @ scaled)
                yield batch

    others = [x for x in rows.schema.fields if x.name != "vector"]
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in others)
    return rows.select(*[f"`{x.name}`" for x in others], "vector").mapInPandas(run, f"{kinds}, deviation bigint, whitened array<double>")


def identity_error(whitened: DataFrame, k: int, n: int) -> float:
    """How far the covariance of ``whitened`` is from the identity, at most in an entry."""
    w = [F.col("whitened")[i] for i in range(k)]
    means = whitened.agg(*[F.avg(x) for x in w]).first()
    z = [x - F.lit(m) for x, m in zip(w, means)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = whitened.agg(*[F.sum(z[i] * z[j]) for i, j in pairs]).first()
    return max(abs(s / n - (i == j)) for s, (i, j) in zip(got, pairs))


def embeddings(rows: DataFrame, most: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per vector and component."""
    c = F.col
    kind = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    plain = one_length(rows.select(c(f"`{vec_id}`").alias("vec_id"), c(f"`{vector}`").alias("vector")).where(usable(c("vector"))))
    model = fit(plain, most)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], kind)
    done, n = stored(whiten(plain, model), "whitened"), model.figures.n
    error = identity_error(done, len(model.values), n)
    share = F.array(*[F.lit(x) for x in model.explained])
    return (done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (c("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                    share[c("at")].alias("explained"), F.lit(error).alias("identity_error")))
