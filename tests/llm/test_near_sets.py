"""Links by Jaccard similarity against all pairs."""
import random

import numpy as np

import corpus_pipeline
from linkloom.llm import near_sets, simhash


def plain(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def components(texts):
    """The smallest id of each text's component, from every pair."""
    sets, parent = {i: plain(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def corpus():
    """Near copies at all distances, a large group of them, and a line that all texts have."""
    rng, line = random.Random(8), [f"licence{k}" for k in range(12)]
    texts = []
    for b in range(25):
        base = [f"b{b}w{k}" for k in range(rng.choice([5, 20, 60, 200]))]
        texts += [base, base, *[edited(rng, base, max(1, len(base) * x // 100)) + line for x in (0, 1, 1, 2, 2, 3, 4)], [*base[:-2], *line]]
    hot = [f"hot{k}" for k in range(120)]
    texts += [edited(rng, hot, rng.randint(0, 2)) for _ in range(60)]
    return {i: " ".join(t) for i, t in enumerate(texts)}


def linked(found):
    """The smallest node that each one is connected with."""
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i
    for a, b in found:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in parent}


def test_components_equal_all_pairs(make_docs):
    texts = corpus()
    want = components(texts)
    docs = make_docs([(i, t, "en", "s") for i, t in texts.items()])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, percent=80).collect()}
    assert got == want and 25 < len(set(want.values())) < len(want)


def test_neither_order_nor_crowds_decide_what_is_found(make_docs, monkeypatch):
    texts = corpus()
    docs = make_docs([(i, t, "en", "s") for i, t in texts.items()])
    want = linked(near_sets.links(docs, "text", 5, 80).collect())
    assert linked(near_sets.links(docs, "text", 5, 80, counted=False).collect()) == want
    monkeypatch.setattr(near_sets, "CROWD", 2)
    monkeypatch.setattr(near_sets, "SPLIT_COST", 0)
    assert linked(near_sets.links(docs, "text", 5, 80, counted=False).collect()) == want


def test_bitmaps_never_rule_out_a_similar_pair():
    rng = random.Random(4)
    for size in (1, 2, 7, 60, 700, 5000):
        own = near_sets.shingles(" ".join(f"w{rng.random()}" for _ in range(size)), 1)
        for gone in (0, 1, size // 10, size // 2):
            other = near_sets.shingles(" ".join(f"x{rng.random()}" for _ in range(gone + 1)), 1)
            other = np.unique(np.concatenate([own[gone:], other]))
            apart = np.bitwise_count(near_sets.bitmap(own) ^ near_sets.bitmap(other)).sum()
            assert apart <= len(np.setxor1d(own, other))


def test_a_large_group_of_near_copies_needs_few_pairs(make_docs, monkeypatch):
    """Every text with edits of its own: neighbours by size share too few keys to be linked."""
    rng, base = random.Random(5), [f"g{k}" for k in range(120)]
    texts = {i: " ".join(edited(rng, base, rng.randint(1, 3))) for i in range(500)}
    docs = make_docs([(i, t, "en", "s") for i, t in texts.items()])
    rows, write = [], near_sets.settle
    monkeypatch.setattr(near_sets, "settle", lambda df: [out := write(df), rows.append(out.count())][0])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, percent=80).collect()}
    assert max(rows) < 30 * 500 and got == components(texts)


def test_small_equal_sets_outlast_the_splits(make_docs, monkeypatch):
    """Two or three shingles in all, fewer than a split key stands for, in a crowd."""
    texts = []
    for p in range(6):
        for period in (2, 3):
            words = [f"p{p}q{period}r{k % period}" for k in range(12)]
            texts += [words[:4 + period + k] for k in range(5)]
            texts += [[*words[i:i + 5], f"own{p}x{period}x{i}x{k}"] for i in range(period) for k in range(8)]
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    docs = make_docs([(i, t, "en", "s") for i, t in texts.items()])
    monkeypatch.setattr(near_sets, "CROWD", 0)
    monkeypatch.setattr(near_sets, "SPLIT_COST", 0)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, percent=80).collect()}
    assert got == components(texts)


def test_a_phrase_of_all_texts_makes_no_pairs(spark, make_docs, monkeypatch):
    docs = make_docs([(i, " ".join([f"u{i}x{k}" for k in range(4)] + [f"common{k}" for k in range(5)] + [f"v{i}x{k}" for k in range(4)]), "en", "s")
                      for i in range(1500)])
    rows, write = [], near_sets.settle
    monkeypatch.setattr(near_sets, "settle", lambda df: [out := write(df), rows.append(out.count())][0])
    assert near_sets.links(docs, "text", 5, 80).count() == 0 and max(rows) == 0
    # Without counts the phrase may be a key of all texts; the crowd is split, not paired.
    rows.clear()
    assert near_sets.links(docs, "text", 5, 80, counted=False).count() == 0 and max(rows) < 20 * 1500


def test_the_stage_drops_copies_that_fingerprints_miss(spark, sf, make_docs):
    texts = corpus()
    docs = make_docs([(i, t, "en", "s") for i, t in texts.items()])
    got = sorted(r.doc_id for r in corpus_pipeline.dedup(spark, docs, sf).collect())
    assert got == sorted(set(components(texts).values()))
    assert len(got) < simhash.deduplicate(docs, shingle=simhash.SHINGLE, percent=None).count()


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd, shingle=5, percent=80).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.deduplicate(odd, shingle=5, percent=80).count() == 7
    assert simhash.deduplicate(none, shingle=5, percent=80).count() == 0


def test_fingerprints_and_trees_find_links_that_are_checked(spark, make_docs, monkeypatch):
    texts = corpus()
    docs = make_docs([(i, t, "en", "s") for i, t in texts.items()])
    prints = {near_sets.node(t) - (1 << 64 if near_sets.node(t) >> 63 else 0): simhash.majority(near_sets.shingles(t, 5).view(np.uint64))
              for t in texts.values()}
    found = [(r.a, r.b) for r in simhash.candidates(docs, "text", 5).collect()]
    assert found and all((prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS for a, b in found)
    near = linked([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS])
    assert linked(found) == near
    searched, search = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes: [searched.append(nodes.count()), search(nodes)][1])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, percent=80).collect()}
    assert searched == [len(set(prints.values()))] and got == components(texts)


def test_texts_are_named_once(spark, monkeypatch):
    """Steps that need the texts read them with their names, without naming them again beside it."""
    texts = ["a b c d e f g", "A  b c d e f g", None, "x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    named = near_sets.named_texts(docs, "text")
    assert "Python" not in named._jdf.queryExecution().executedPlan().toString()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert sorted(r.node for r in named.collect()) == sorted(signed(near_sets.node(t)) for t in texts)
    calls, plain = [], near_sets.named_texts
    monkeypatch.setattr(near_sets, "named_texts", lambda *a: calls.append(a) or plain(*a))
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [0, 2, 3]
    assert len(calls) == 1
