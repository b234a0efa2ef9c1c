"""Pieces by the plain tokenizer; bins against a document-by-document best-two-fit."""
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkloom.llm import packing, queries
from linkloom.llm.packing import WordIds, pack, patterns, sequences, tokenize

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ROOT = Path(packing.__file__).parents[2]


def one_by_one(lengths, capacity):
    """Best-two-fit as described, one bin after the other."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        gap, bin_ = capacity, []
        for x in list(left):
            if x <= gap:
                bin_.append(x)
                left.remove(x)
                gap -= x
        if gap and len(bin_) > 1:
            small = min(bin_)
            best = max(((a + b, a, b) for i, a in enumerate(left) for b in left[i + 1:] if a + b <= gap + small), default=(0,))
            if best[0] > small:
                _, a, b = best
                bin_.remove(small)
                bin_ += [a, b]
                left.remove(a)
                left.remove(b)
                left = sorted([*left, small], reverse=True)
        bins.append(sorted(bin_, reverse=True))
    return bins


def test_patterns_equal_one_by_one():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([7, 20, 50])
        lengths = [min(capacity, max(1, int(rng.gauss(rng.choice([2, capacity / 3, capacity / 2]), 3)))) for _ in range(rng.randint(0, 60))]
        counts = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, dtype=int)
        got = [sorted((x for x, n in content for _ in range(n)), reverse=True) for times, content in patterns(counts) for _ in range(times)]
        want = one_by_one(lengths, capacity)
        assert sorted(x for b in got for x in b) == sorted(lengths) and all(sum(b) <= capacity for b in got)
        assert len(got) == len(want)
        assert sorted(map(sum, got)) == sorted(map(sum, want))


def test_two_tighter_ones_replace_the_smallest():
    counts = np.bincount([6, 3, 2, 2], minlength=11)
    assert [c for _, c in patterns(counts)][0] == [(6, 1), (2, 2)]


def test_cached_ids_are_the_tokenizers(sf):
    tokenizer, words = Tokenizer.from_file(VOCABULARY), WordIds(VOCABULARY, most=400)
    texts = pd.read_parquet(f"{sf}/documents.parquet").text.tolist()
    texts += ["", " ", "\n\n", "it's DON'T we'll", "á e ́ x", "<|endoftext|> a<|startoftext|>b", "tab\tand\x0bmore\x85 end",
              "Straße ΣΑΣ İI ǅ", "12,345.67 $$$ -- 😀👍🏽 ‍", "日本語 テスト", "x" * 3000, "\x1c\x1f y", "ﬁ ½ Ⅷ",
              "TÜRKİYE BİRİNCİSİ. GELDİ, GİTTİ!", "rock''n 'tis x'tell '' don't, 's", "a<\u0338b e\u0301. 1\u20e3 (é) “q” …", "word " * 120_000,
              "y" * 600_000 + " z", "हिन्दी में, 한국어 각", "a_b __c__ 3rd 4²x"]
    for got, t in zip([*words.of(texts[:90]), *(next(words.of([t])) for t in texts[90:])], texts):
        want = np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert got == want, t[:40]


def test_random_strings_are_cut_like_the_tokenizer():
    """Cased, combining, numeric, punctuation and blank characters in any order."""
    rng = random.Random(4)
    letters = "aBzİıſKÅéÉßΣςǅДж中한각ﬁªʰ"
    marks = "\u0301\u0307\u0338\u0327\u200d\ufe0f\u0345\u1161\u0940"
    signs = "'.,!?-<>|=(){}[]_~\"`^$%&*+/\\:;@#“”…—¿€😀"
    pool = letters * 3 + marks + signs + "'" * 6 + "0123456789²½Ⅷ٣" + " \n\t\x85\xa0\u2028\x1c" + "   stre'llvdm" * 2
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(20_000)]
    tokenizer, words = Tokenizer.from_file(VOCABULARY), WordIds(VOCABULARY, most=5000)
    want = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for got, t, w in zip(words.of(texts), texts, want) if got != np.array(w.ids, dtype="<u4").tobytes()]
    assert not wrong, (len(wrong), wrong[:5])


def test_the_store_stays_bounded():
    words = WordIds(VOCABULARY, most=300)
    rng = random.Random(2)
    for _ in range(20):
        list(words.of([" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200))]))
        assert len(words.known) <= 500


def test_a_worker_keeps_one_tokenizer_without_threads():
    """Every new tokenizer, and every thread of one, would hold memory for as long as the worker lives."""
    code = f"""
import os
from linkloom.llm.packing import WordIds
first = WordIds({VOCABULARY!r})
before = len(os.listdir("/proc/self/task"))
for k in range(3):
    words = WordIds({VOCABULARY!r})
    assert words.tokenizer is first.tokenizer and not words.known
    list(words.of([f"{{i}}-{{k}} \u65e5\u672c{{i}}, x{{i}}'s" for i in range(500)]))
assert len(os.listdir("/proc/self/task")) == before
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def check(rows, capacity=4096):
    rows = rows.sort_values(["sequence_id", "offset"])
    for _, g in rows.groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= capacity


def test_query_against_the_tokenizer(spark, sf):
    got = queries.QUERIES["op2_best_fit_packing"](spark, sf).toPandas()
    check(got)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1
    tokenizer, want = Tokenizer.from_file(VOCABULARY), {}
    for r in pd.read_parquet(f"{sf}/documents.parquet").itertuples():
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[r.doc_id, k] = (at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want


def test_a_hot_length_and_sequences(spark):
    rows = spark.createDataFrame([(i, 0, 5 if i % 3 else 1 + i % 9, bytes([i % 251]) * 4) for i in range(900)],
                                 "doc_id LONG, piece INT, length LONG, ids BINARY")
    got = pack(rows, 16).toPandas()
    assert len(got) == 900 and sorted(got.doc_id) == list(range(900))
    check(got, 16)
    assert got.sequence_id.nunique() <= 1.12 * got.length.sum() / 16 + 1


def test_odd_rows(odd, none):
    pieces = tokenize(odd.withColumn("length", F.lit("old")), VOCABULARY, capacity=64)
    clashing = pieces.selectExpr("*", "'x' AS offset", "'y' AS Sequence_ID", "1 AS uid", "2 AS size", "3 AS salt", "4 AS k", "5 AS in0", "6 AS rank")
    again = pack(clashing, 64)
    assert again.columns == [*pieces.columns, "uid", "size", "salt", "k", "in0", "rank", "sequence_id", "offset"]
    check(again.select(*pieces.columns, "sequence_id", "offset").toPandas(), 64)
    packed = pack(pieces, 64)
    got = packed.toPandas()
    check(got, 64)
    whole = got.groupby("doc_id", dropna=False).length.sum()
    assert whole[1.0] == 1 and whole[2.0] == 1 and whole[3.0] == 1
    assert got[got.doc_id == 4].length.sum() == 2 * (24000 + 1)
    full = sequences(packed).toPandas()
    assert (full.ids.map(len) == 4 * full.length).all() and full.length.sum() == got.length.sum()
    assert pack(tokenize(none, VOCABULARY)).count() == 0
