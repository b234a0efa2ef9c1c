"""Posteriors against plain Python; shrinking; labels that are missing."""
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from linkloom.llm import queries, site_quality
from linkloom.llm.site_quality import Classifier, MEASURES, form, judge, train

K = len(MEASURES)
#: Evidence is the share of symbols alone.
FIXED = Classifier((0.0,) * K, (1.0,) * K, (3.0, *[-8.0 if m == "symbols" else 0.0 for m in MEASURES]), 0.8)


def plain_rates(rows, model, host_k, path_k):
    """(host rate, path rate, quality) of each (source, lang, text)."""
    e = [round(float(model.evidence(np.array([form(t)]))[0]), 6) for _, _, t in rows]
    p = [round(1e6 / (1 + math.exp(-(x + math.log(model.base / (1 - model.base)))))) for x in e]
    mean = sum(p) / len(p) / 1e6
    out = []
    for i, (s, la, _) in enumerate(rows):
        host = [p[j] for j, r in enumerate(rows) if r[0] == s and j != i]
        path = [p[j] for j, r in enumerate(rows) if r[:2] == (s, la) and j != i]
        h = (host_k * mean + sum(host) / 1e6) / (host_k + len(host))
        q = (path_k * h + sum(path) / 1e6) / (path_k + len(path))
        out.append((h, q, 1 / (1 + math.exp(-(e[i] + math.log(q / (1 - q)))))))
    return out


def test_posteriors(make_docs, monkeypatch):
    monkeypatch.setattr(site_quality, "_weight", lambda *a: 5.0)
    rng = np.random.default_rng(1)
    rows = [(str(rng.choice(["a", "b", "c"])), str(rng.choice(["en", "de"])),
             " ".join(f"w{i}" + "#" * int(rng.integers(0, 4)) for i in range(12))) for _ in range(60)]
    rows = [(None if s == "c" else s, la, t) for s, la, t in rows]
    got = judge(make_docs([(i, t, la, s) for i, (s, la, t) in enumerate(rows)]), FIXED).toPandas().set_index("doc_id")
    for i, (h, p, q) in enumerate(plain_rates(rows, FIXED, 5.0, 5.0)):
        assert abs(got.host_rate[i] - h) < 2e-6 and abs(got.path_rate[i] - p) < 2e-6 and abs(got.quality[i] - q) < 5e-6
        assert got.kept[i] == (got.quality[i] >= 0.5)


def test_a_bad_site_pulls_its_doubtful_documents_down(make_docs):
    good, bad = "plain words stand here in a row", "words## with## marks## stand## here##"
    doubtful = "some# words# here# are not so clear now"
    rows = [(i, good, "en", "good") for i in range(200)] + [(300 + i, bad, "en", "bad") for i in range(200)]
    rows += [(900, doubtful, "en", "good"), (901, doubtful, "en", "bad"), (902, doubtful, "en", "single")]
    got = {r.doc_id: r for r in judge(make_docs(rows), FIXED).collect()}
    assert got[900].quality > got[902].quality > got[901].quality
    assert got[900].evidence == got[901].evidence


def test_labels_are_learned_and_hold_out(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = train(docs, labels.where("doc_id % 2 = 0"))
    got = judge(docs, model).select("doc_id", "quality").toPandas().merge(
        pd.read_parquet(f"{big}/labels.parquet").rename(columns={"quality": "y"}), on="doc_id")
    out = got[got.doc_id % 2 == 1]
    assert ((out.quality >= 0.5) == (out.y == 1)).mean() > 0.97
    query = queries.QUERIES["op4_quality_classifier"](spark, big).toPandas()
    assert len(query) == docs.count() and query.doc_id.is_unique and query.quality.between(0, 1).all()


def test_the_sample_is_bounded(spark, make_docs):
    docs = make_docs([(i, f"text {i}" + "#" * (i % 2), "en", "s") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id LONG, quality INT")
    seen = []
    fit = site_quality.fit
    try:
        site_quality.fit = lambda rows, good, s: seen.append(len(rows)) or fit(rows, good, s)
        train(docs, labels, s=site_quality.SiteSettings(sample=100))
    finally:
        site_quality.fit = fit
    assert 60 < seen[0] < 140


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 1), (7, 0), (None, 1), (5, None)], "doc_id LONG, quality INT")
    clash = odd.withColumn("kept", F.lit("old")).withColumn("_host", F.lit(1)).withColumn("path_rate", F.lit(1))
    got = judge(clash, train(clash, labels))
    assert got.columns == [*odd.columns, "_host", "evidence", "host_rate", "path_rate", "quality", "kept"]
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r.quality <= 1 and r.kept is not None for r in rows)
    blind = judge(odd, train(odd, labels.where("quality = 1"))).collect()
    assert all(r.kept and r.evidence == 0 for r in blind)
    assert judge(none, FIXED).count() == 0
    assert judge(odd, train(none, labels)).count() == odd.count()
