"""Whitening against a dense eigenvalue solver."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import queries, whitening as wh

KIND = "vec_id LONG, embedding ARRAY<FLOAT>"


def spectrum(values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


def test_inertia():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 20):
        a = rng.standard_normal((n, n))
        a = a + a.T
        assert wh.above_zero(a) == (np.linalg.eigvalsh(a) > 0).sum()
    assert wh.above_zero(np.array([[0.0, 1], [1, 0]])) == 1 and wh.above_zero(np.zeros((3, 3))) == 0


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 30), 10.0 ** -np.arange(0, 12), [5, 5, 5, 1, 1], [3.0] * 12, [1e6, *np.linspace(1, 1.01, 20)], [2, 1, 0, 0],
    [1.0], [0.0, 0.0]])
def test_components(spark, values):
    v = spectrum(values)
    v = (v + v.T) / 2
    got, vectors = wh.components(spark, v, 4)
    want = np.linalg.eigvalsh(v)[::-1][:4]
    want = want[want > wh.NOISE * max(np.trace(v), 1e-300)]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12 * max(1, abs(v).max()))
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)
    assert np.abs(v @ vectors - vectors * got).max(initial=0) <= 1e-11 * max(1, abs(v).max())


def test_query_against_a_dense_solver(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    got = queries.QUERIES["op11_embedding_whitening"](spark, sf).toPandas()
    x = np.floor(1024 * np.array(rows.embedding.tolist(), dtype=float)).astype(np.int64) + 100_000
    n, z = len(x), x - x.mean(axis=0)
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    want = z @ u / np.sqrt(e)
    own = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    assert all(min(abs(own[:, i] - want[:, i]).max(), abs(own[:, i] + want[:, i]).max()) < 1e-9 for i in range(8))
    assert (got.n == n).all() and (got.identity_error < 1e-9).all()
    assert np.allclose(got.groupby("component").explained.first(), e / np.trace(z.T @ z / n), rtol=1e-9)
    dev = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert (got[got.component == 1].set_index("vec_id").deviation.loc[rows.vec_id].to_numpy() == dev).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in rng.standard_normal(3)]) for i in range(20)]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 1.0, 1.0]), (55, [1.0]),
           (56, [1e20, 0.0, 0.0])]
    docs = spark.createDataFrame([*good, *bad, good[0], (None, [0.0, 0.0, 0.0])], KIND)
    docs = docs.selectExpr("*", "1 AS vector", "2 AS whitened", "3 AS deviation", "4 AS n")
    got = wh.embeddings(docs).toPandas()
    assert set(got.component) == {1, 2, 3} and len(got) == 22 * 3 and got.vec_id.isna().sum() == 3
    assert (got.n == 22).all() and (got.identity_error < 1e-9).all() and abs(got.groupby("component").explained.first().sum() - 1) < 1e-9


def test_no_components(spark):
    assert wh.embeddings(spark.createDataFrame([], KIND)).count() == 0
    assert wh.embeddings(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], KIND)).count() == 0


def test_a_hot_vector_and_large_entries(spark):
    rows = [(i, [2.0 ** 40, float(i)] if i % 3 else [1.0, 7.0]) for i in range(90)]
    got = wh.embeddings(spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").withColumn("x", F.lit(1))).toPandas()
    # The second dimension is below the noise of the first.
    assert len(got) == 90 and got.deviation.isna().all() and (got.identity_error < 1e-9).all()
