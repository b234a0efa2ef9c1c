"""The pipeline's stages, and the entry point with and without the subpackage."""
import importlib
import sys

import pandas as pd

import corpus_pipeline
from linkloom.llm import simhash


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, before, sf), name)
        kept[name] = docs
        assert docs.count() > 0
        if name != "best_fit_packing":
            assert docs.columns == columns and docs.schema.simpleString() == before.schema.simpleString()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    good = kept["quality_classifier"].toPandas()
    assert not set(labels[labels.quality == 0].doc_id) & set(good.doc_id)
    assert set(labels[labels.quality == 1].doc_id) <= set(good.doc_id)
    rules, unique = kept["quality_rules"], kept["simhash_near_dedup"].toPandas()
    groups = simhash.near_duplicates(rules).toPandas()
    assert sorted(unique.doc_id) == sorted(groups.component_id.unique())
    words = lambda df: {k: n for k, n in zip(df.doc_id, [len(t.encode().split()) for t in df.text])}
    have, mixed = words(unique), kept["mixing"].toPandas()
    taken = mixed.assign(n=[len(t.encode().split()) for t in mixed.text]).groupby("doc_id").n.sum()
    assert all(n <= 2 * have[i] for i, n in taken.items()) and abs(taken.sum() / sum(have.values()) - 1.5) < 0.1
    last = kept["best_fit_packing"].toPandas()
    assert set(last.doc_id) == set(mixed.doc_id) and last.groupby("sequence_id").length.sum().max() <= 4096


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_entry_point_without_the_subpackage(monkeypatch):
    """Only the absence of the subpackage is forgiven, not a fault in it."""
    import __spark_entry__
    full = set(__spark_entry__.queries())
    assert {"pipeline"} | {x for x in full if x.startswith("op")} > {"pipeline"}

    class Gone:
        @staticmethod
        def find_spec(name, path=None, target=None):
            if name.startswith(Gone.what):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
    for what in ("linkloom.llm", "corpus_pipeline", "numpy.linalg.not_there"):
        Gone.what = what
        with monkeypatch.context() as m:
            for name in [x for x in sys.modules if x.startswith(("linkloom.llm", "corpus_pipeline", "__spark_entry__"))]:
                m.delitem(sys.modules, name)
            m.setattr(sys, "meta_path", [Gone, *sys.meta_path])
            names = set(importlib.import_module("__spark_entry__").queries())
        assert names == full if what.startswith("numpy") else not any(x.startswith(("op1", "op2", "pipeline")) for x in names)
