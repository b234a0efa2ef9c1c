"""Fingerprints against plain Python; homomorphism; neighbours across buckets."""
import hashlib
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkloom.llm import multiset_hash, queries
from linkloom.llm.multiset_hash import as_text, combine, compare_edits, fingerprints


def vector(paragraph):
    h = hashlib.md5(paragraph.encode()).hexdigest()
    words = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    return [2 * (words[i // 32] >> (i % 32) & 1) - 1 for i in range(128)]


def lanes(text):
    out = [0] * 128
    for p in re.sub(r"([.!?]) ", "\\1\n", text).split("\n"):
        if p.strip(" "):
            out = [(a + b) % 65536 for a, b in zip(out, vector(p))]
    return out


def alike(a, b):
    c = lambda x: x - 65536 if x >= 32768 else x
    sq = lambda v: sum(c(x) ** 2 for x in v)
    both = sq(a) + sq(b)
    return 1.0 if not both else round(min(1.0, max(0, both - sq([(x - y) % 65536 for x, y in zip(a, b)])) / both), 6)


def plain(docs):
    """{(doc_id, text): figures}, by the order of descending ids."""
    rows = sorted(((i is None, -(i or 0), t or "", i) for i, t in docs))
    out = []
    for k, (_, _, t, i) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][2]
        m = len(t) // 3
        e = t[:len(t) - m] + nxt[:m]
        a, b = lanes(t), lanes(e)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, alike(a, b), alike(a, lanes(nxt))))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, list(r.own), list(r.edited), r.near_edited, r.near_next)
                   for r in df.collect()), key=str)


def close(got, want):
    want = sorted(want, key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=2e-6) and g[6] == pytest.approx(w[6], abs=2e-6)


def test_random_documents(spark, make_docs):
    rng = random.Random(8)
    texts = ["One line. Two! Three?", "é😀\n\n b. ", "same", "same", ""] + [
        "\n".join(rng.choice(["alpha", "beta. gamma", "delta! x", " "]) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    ids = rng.sample(range(-50, 1 << 40), len(texts))
    close(rows_of(compare_edits(make_docs([(i, t, "en", "s") for i, t in zip(ids, texts)]))), plain(list(zip(ids, texts))))


def test_query_against_plain_python(spark, sf):
    got = queries.QUERIES["op6_document_fingerprints"](spark, sf).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    want = {w[0]: w for w in plain(list(zip(docs.doc_id, docs.text)))}
    for r in got.itertuples():
        w = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == w[1:3]
        assert r.fingerprint == "".join(f"{x:04x}" for x in w[3]) and r.edited_fingerprint == "".join(f"{x:04x}" for x in w[4])
        assert r.near_edited == pytest.approx(w[5], abs=2e-6) and r.near_next == pytest.approx(w[6], abs=2e-6)
    assert len(got) == len(docs) and got.near_edited.mean() > 0.45 > got.near_next.mean()


def test_order_does_not_count_and_parts_add_up(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc"), (2, "c\na\nb"), (3, "a\nb"), (4, "c"), (5, "c\nc\na\nb")], "i INT, t STRING")
    got = {r.i: r.f for r in fingerprints(rows, ["i"], {"t": "f"}).collect()}
    assert got[1] == got[2] != got[5]
    both = spark.createDataFrame([(got[3], got[4], got[1])], "a ARRAY<LONG>, b ARRAY<LONG>, ab ARRAY<LONG>")
    r = both.select(combine(F.col("a"), F.col("b")).alias("ab"), combine(F.col("ab"), F.col("b"), -1).alias("a"), as_text(F.col("a")).alias("s")).first()
    assert r.ab == got[1] and r.a == got[3] and len(r.s) == 512


def test_odd_rows(odd, none, make_docs):
    clash = odd.withColumn("pos", F.lit("old")).withColumn("bucket", F.lit(1)).withColumn("own", F.lit(1))
    close(rows_of(compare_edits(clash)), plain([(r.doc_id, r.text) for r in odd.collect()]))
    one = rows_of(compare_edits(make_docs([(3, "abc", "en", "s")])))
    close(one, plain([(3, "abc")]))
    close(rows_of(compare_edits(make_docs([(None, "x y", "en", "s"), (None, None, "en", "s")]))), plain([(None, "x y"), (None, None)]))
    assert compare_edits(none).count() == 0


def test_main_path_is_native_and_shuffles_texts_once(spark, sf):
    plan = compare_edits(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan
