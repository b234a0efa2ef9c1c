"""What Python workers hold: batches, what stays after a task, and no workers for local tables."""
import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import functions as F

from linkloom.llm import near_sets
from linkloom.llm.common import lean, local_table, small_batches
from linkloom.llm.mixing import mix, word_count
from linkloom.llm.packing import pack

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_batches_of_long_texts_are_small(spark):
    small_batches(spark)
    texts = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield batch.assign(text=batch["text"].str.len()).groupby(lambda _: 0).sum()

    got = [r.text for r in texts.mapInPandas(sizes, "text long").collect()]
    assert sum(got) == 200 * 100_000 and max(got) <= 5_000_000


def test_a_task_lets_go_of_its_memory():
    """Freed blocks below one that stays are given back, too."""
    code = """
import re
from linkloom.llm.common import lean
used = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
stays = []

def run(batches):
    held = [bytes(700) for _ in range(150_000)]
    stays.append(bytes(700))
    for batch in batches:
        yield len(held)

before = used()
assert list(lean(run)([1])) == [150_000]
assert used() - before < 40, (before, used())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_local_tables_need_no_python_worker(spark, make_docs, monkeypatch):
    rows = [("a", 1, 0.5), (None, None, None), ("\u00e9\U0001f600", 1 << 62, -0.0)]
    kinds = {"s": pa.string(), "n": pa.int64(), "x": pa.float64()}
    docs = make_docs([(i, "some words " * (i + 1), "en", f"s{i % 3}" if i % 4 else None) for i in range(40)])
    pieces = spark.createDataFrame([(i, 0, 1 + i % 9) for i in range(100)], "doc_id LONG, piece INT, length LONG")

    def refused(*args, **kwargs):
        raise AssertionError("a list would go through Python workers")
    monkeypatch.setattr(SparkContext, "parallelize", refused)
    got = local_table(spark, rows, kinds)
    assert got.schema.simpleString() == "struct<s:string,n:bigint,x:double>" and [tuple(r) for r in got.collect()] == rows
    assert local_table(spark, [], kinds).collect() == []
    assert mix(docs.withColumn("size", word_count(F.col("text")))).count() == 40
    assert pack(pieces, 16).count() == 100


def test_cells_are_counted_over_tasks(spark):
    texts = [f"a{i % 7} b c d{i % 3} e f g" for i in range(60)] + [None, "", "x"]
    docs = spark.createDataFrame([(t,) for t in texts], "text STRING").repartition(9)
    got = near_sets._counts(near_sets.named_texts(docs, "text"), 2)
    want = Counter()
    # Each task counts a text once; the same text may lie in several tasks.
    for t in set(texts):
        want.update((near_sets.shingles(t, 2) & (near_sets.CELLS - 1)).tolist())
    assert got.dtype == np.int32 and len(got) == near_sets.CELLS
    assert set(np.flatnonzero(got).tolist()) == set(want) and all(n <= got[x] <= 60 for x, n in want.items())
    one = near_sets._counts(near_sets.named_texts(docs.coalesce(1), "text"), 2)
    assert {x: n for x, n in enumerate(one.tolist()) if n} == dict(want)
