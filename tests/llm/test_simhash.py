"""SimHash links and components against all pairs."""
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from linkloom.llm import queries, simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def all_pairs(values):
    """Smallest member of each value's component, from every pair."""
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    arr = np.array(list(values), dtype=np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3):
            a, b = root(v), root(values[j])
            parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in values}


def test_fingerprint_is_that_of_the_definition():
    for t in [None, "", " \n", "One", "one two", "A b C d e F g", "a b c a b c a b c", "ÄÖ ü x \x1f y", "z " * 5000]:
        assert simhash.fingerprint(t) == plain(t)


def test_tree_search_finds_all_and_only_near_ones():
    rng = random.Random(3)
    values = np.array([rng.getrandbits(64) for _ in range(300)], dtype=np.uint64)
    near = values ^ np.uint64(0b10110000)
    found = {(int(node), int(i)) for node, hits in simhash.BKTree(values).near(near) for i in hits}
    want = {(i, j) for i in range(300) for j in range(300) if int(values[i] ^ near[j]).bit_count() <= 3}
    assert found == want and len(want) >= 300


@pytest.mark.parametrize("max_tree", [2048, 60])
def test_components_equal_all_pairs(spark, max_tree):
    """A dense cluster fills shards; with small trees they are cut into many."""
    rng = random.Random(5)
    base, values = rng.getrandbits(64), set()
    while len(values) < 300:
        v = base
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    chain = [rng.getrandbits(64)]
    for k in range(30):  # each link three bits from the one before
        chain.append(chain[-1] ^ (0b111 << 2 * k))
    values |= set(chain) | {rng.getrandbits(64) for _ in range(200)}
    values = sorted(np.array(sorted(values), dtype=np.uint64).view(np.int64).tolist())
    rows = spark.createDataFrame([(v,) for v in values], "fp LONG")
    got = {r.fp: r.root for r in simhash.components(simhash.links(rows, max_tree)).collect()}
    want = all_pairs([v & (2 ** 64 - 1) for v in values])
    groups, mine = {}, {}
    for v in values:
        groups.setdefault(want[v & (2 ** 64 - 1)], set()).add(v)
        mine.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    assert all(root == min(members) for root, members in mine.items())


def test_query_over_a_whole_table(spark, sf):
    got = queries.QUERIES["op9_simhash_near_dedup"](spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    prints = {i: plain(t) for i, t in zip(docs.doc_id, docs.text)}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got.itertuples()} == prints
    want = all_pairs(sorted(set(prints.values())))
    first = {}
    for i, p in prints.items():
        first[want[p]] = min(i, first.get(want[p], i))
    assert {r.doc_id: r.component_id for r in got.itertuples()} == {i: first[want[p]] for i, p in prints.items()}
    assert len(got) == len(docs)


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    assert {c for i, c in got if i in (1, 2, 3)} == {1} and {c for i, c in got if i is None} >= {1}
    assert sorted(c for i, c in got if i == 6) == [5, 6] and [c for i, c in got if i == 4] == [4, 4]
    kept = simhash.deduplicate(odd.withColumn("component_id", F.lit("x")).withColumn("fp", F.lit(1)))
    assert kept.columns == [*odd.columns, "component_id", "fp"]
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id) == [(False, x) for x in (1, 4, 5, 6, 7, 8)]
    assert kept.count() == 7  # and the one text whose only row has no id
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


def test_a_hot_group_of_copies(spark, make_docs):
    rows = [(i, "the very same text again and again", "en", "s") for i in range(60)]
    rows += [(100 + i, f"text number {i * 7919} stands alone {i}", "en", "s") for i in range(100)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(make_docs(rows)).collect()}
    assert all(got[i] == 0 for i in range(60)) and len(got) == 160
