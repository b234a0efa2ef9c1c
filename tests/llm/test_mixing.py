"""Targets, Sainte-Lague seats and the taken words."""
import heapq
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkloom.llm import mixing, queries
from linkloom.llm.mixing import MixSettings, apportion, mix, quotas, targets, word_count, write_out


def seats_by_quotient(weights, caps, seats):
    got = [0] * len(weights)
    heap = [(-w, i) for i, w in enumerate(weights) if w > 0 and caps[i]]
    heapq.heapify(heap)
    while seats and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        seats -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def test_apportion_equals_quotient_by_quotient():
    rng = random.Random(2)
    for _ in range(200):
        k = rng.randint(0, 9)
        weights = [rng.choice([0, 1, 1, 5, rng.random() * 50]) for _ in range(k)]
        caps = [rng.randint(0, 30) for _ in range(k)]
        seats = rng.randint(0, 120)
        assert apportion(weights, caps, seats) == seats_by_quotient(weights, caps, seats)


def test_targets():
    got = targets([(None, 100), ("b", 100), ("a", 10), ("c", 0)])
    assert [x[0] for x in got] == ["a", "b", "c", None]
    t = {x[0]: x[2] for x in got}
    assert t["a"] == 20 and t["c"] == 0 and abs(sum(t.values()) - 1.5 * 210) < 1e-9
    assert all(x[2] <= 2 * x[1] + 1e-9 for x in got)
    # b and null weigh 1 and 3; null reaches its cap of 200 first.
    assert t[None] == pytest.approx(200) and t["b"] == pytest.approx(95)


def test_query_reaches_the_targets(spark, sf):
    got = queries.QUERIES["op10_mixing"](spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in zip(docs.doc_id, docs.text)}
    assert dict(zip(got.doc_id, got["size"])) == sizes
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    by = got.merge(docs[["doc_id", "source"]]).groupby("source").agg(
        size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all()
    want = {x[0]: x[2] for x in targets(list(by["size"].items()))}
    assert all(abs(by.target[s] - want[s]) < 1e-6 for s in by.index)
    assert ((by.taken - by.target).abs() <= 256 + 0.03 * by.target).all()
    again = queries.QUERIES["op10_mixing"](spark, sf).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_blocks_of_a_shard_are_taken_once_each():
    for source, shard, tokens, *_, n, passes, extra, step, first in quotas([("a", 0, 900), ("a", 1, 130), ("b", 0, 5000)]):
        chosen = {j for j in range(n) if (j * step + first) % n < extra}
        assert len(chosen) == extra and 0 <= passes <= 2 and (passes < 2 or not extra)


def test_written_copies_hold_the_taken_words(spark, make_docs):
    rng = random.Random(4)
    docs = make_docs([(i, "  ".join(f"d{i}w{k}" for k in range(rng.randint(0, 300))), "en", rng.choice("ab")) for i in range(60)])
    mixed = mix(docs.withColumn("size", word_count(F.col("text"))), settings=MixSettings(block=16))
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    out = write_out(mixed, docs.columns, n_chars="n_chars")
    words, whole = {}, {r.doc_id: r.text.split() for r in docs.collect()}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        for w in r.text.split():
            words[w] = words.get(w, 0) + 1
            assert w in whole[r.doc_id]
    for i, all_ in whole.items():
        assert sum(words.get(w, 0) for w in all_) == taken[i] and all(words.get(w, 0) <= 2 for w in all_)


@pytest.mark.parametrize("words", [1, 2, 4, 30])
@pytest.mark.parametrize("rows", [40, 1000, 40_000])
def test_short_documents_reach_the_target(spark, words, rows):
    """Whatever the size of the table; one source is far smaller than the other, one tiny."""
    docs = spark.range(rows).selectExpr("id AS doc_id", f"CASE WHEN id % 10 = 0 THEN 'a' ELSE 'b' END AS source",
                                        f"CASE WHEN id % 10 = 0 THEN {words} ELSE 40 END AS size")
    docs = docs.unionByName(spark.createDataFrame([(-1, "c", 30)], "doc_id LONG, source STRING, size INT"))
    by = mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(by) == 3
    for r in by:
        assert abs(r.taken - r.target) <= 2 + 0.03 * r.target, r


def test_odd_rows(odd, none):
    sized = odd.withColumn("size", word_count(F.col("text"))).withColumn("target", F.lit("old")).withColumn("_n", F.lit(1))
    got = mix(sized)
    assert got.columns == [*odd.columns, "size", "_n", "source_size", "target", "passes", "spans", "taken"]
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert {r.source_size for r in rows if r.source is None} == {3}
    assert mix(none.withColumn("size", F.lit(1))).count() == 0
    assert write_out(got, odd.columns).count() > 0
