"""Code lengths against a byte-by-byte model; held-out accuracy."""
import math
import random
import zlib
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkloom.llm import langid, queries


class Plain:
    """PPM with method C, one byte at a time."""

    def __init__(self, texts):
        self.counts = [defaultdict(lambda: defaultdict(int)) for _ in range(4)]
        for t in texts:
            d = b"\n\n\n" + (t or "").lower().encode()
            for k in range(3, len(d)):
                for o in range(4):
                    self.counts[o][d[k - o:k]][d[k]] += 1

    def bits(self, order, context, byte):
        if order < 0:
            return 8.0
        seen = self.counts[order].get(context)
        if not seen:
            return self.bits(order - 1, context[1:], byte)
        n, d = sum(seen.values()), len(seen)
        if byte in seen:
            return -math.log2(seen[byte] / (n + d))
        return -math.log2(d / (n + d)) + self.bits(order - 1, context[1:], byte)

    def length(self, text):
        d = b"\n\n\n" + text.lower().encode()
        return sum(self.bits(3, d[k - 3:k], d[k]) for k in range(3, len(d)))


def test_exact_code_lengths(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    model = langid.whole_model(langid.learn(spark.read.parquet(f"{sf}/documents.parquet")))
    assert model.langs == sorted(docs.lang.unique())
    texts = [*docs.text[:6], "äöü ßÿ \x00 日本語 zzzqqq", "a", "never seen: ÞÆØ"]
    got = model.lengths([langid.encoded(t) for t in texts], chunk=700)  # chunks end inside texts
    for k, name in enumerate(model.langs):
        plain = Plain(docs.text[docs.lang == name])
        for i, t in enumerate(texts):
            assert got[i, k] == pytest.approx(plain.length(t), rel=1e-6)


def test_held_out_accuracy(spark, sf):
    got = queries.QUERIES["op3_language_id"](spark, sf.replace("0.001", "0.01")).toPandas()
    docs = pd.read_parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out))
    out = both[both.held_out]
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() >= 0.98


def test_only_the_training_fold_is_learned(make_docs):
    rows = make_docs([(i, "abc abc" if i % 2 else "xyz xyz", "aa" if i % 2 else "xx", "s") for i in range(8)])
    model = langid.whole_model(langid.learn(rows.where("lang = 'aa'")))
    assert model.langs == ["aa"] and model.predict(["xyz"])[0][0] == "aa"


def test_forty_languages_in_parts(make_docs, odd, monkeypatch):
    """A model dealt over parts, against one of all counts; no language is cut."""
    rng = random.Random(3)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklm nopqrstuvwxyzé") for _ in range(6)) for _ in range(30)] for k in range(40)}
    rows = [(40 * i + k, " ".join(rng.choice(words[x]) for _ in range(40)), x, "s") for i in range(3) for k, x in enumerate(words)]
    docs = make_docs(rows)
    stats = langid.learn(docs)
    asked = make_docs([(1000 + k, " ".join(rng.choice(w) for _ in range(12)), None, "s") for k, w in enumerate(words.values())])
    asked = asked.unionByName(odd)
    whole = {tuple(r)[:2]: r.score for r in langid.identify(asked, stats, ["doc_id"]).collect()}
    assert stats.small
    monkeypatch.setattr(langid, "BROADCAST_NODES", 0)
    monkeypatch.setattr(langid, "PART_NODES", 5000)
    got = langid.identify(asked.withColumn("row", F.lit(1)).withColumn("score", F.lit(2)), stats, ["doc_id"]).collect()
    assert not stats.small and len(got) == asked.count()
    assert {tuple(r)[:2] for r in got} == set(whole) and all(abs(whole[tuple(r)[:2]] - r.score) < 1e-3 for r in got if r.doc_id and r.doc_id >= 1000)
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id or 0) if r.doc_id and r.doc_id >= 1000] == list(words)
    plain = {x: Plain([t for _, t, y, _ in rows if y == x]) for x in words}
    text = asked.where("doc_id = 1005").first().text
    bits = {x: p.length(text) for x, p in plain.items()}
    want = 1 / sum(2 ** max(-1000, min(bits.values()) - b) for b in bits.values())
    assert [r.score for r in got if r.doc_id == 1005][0] == pytest.approx(want, rel=1e-6) and min(bits, key=bits.get) == "l05"
    assert langid.identify(asked.limit(0), stats, ["doc_id"]).count() == 0


def test_odd_rows(odd, none):
    model = langid.learn(odd)
    clash = odd.withColumn("lang_pred", F.lit("old")).withColumn("score", F.lit(7))
    got = langid.identify(clash, model, ["doc_id"]).collect()
    assert len(got) == odd.count()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    assert {r.lang_pred for r in got if r.doc_id == 8} == {"de"}
    assert langid.whole_model(model).predict(["123 ?!"]) == [("und", 0.0)]
    empty = langid.learn(none)
    assert {r.lang_pred for r in langid.identify(odd, empty, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(none, model, ["doc_id"]).count() == 0
