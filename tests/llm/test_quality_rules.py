"""Measures and fences against plain Python."""
import re

import pandas as pd
from pyspark.sql import functions as F

from linkloom.llm import queries, quality_rules
from linkloom.llm.quality_rules import RuleSettings, apply_rules, measure


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)} if len(words) < 3000 else None
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(hit) if hit is not None else None, len(lines))


def test_measures():
    for t in [None, "", "a", "a b c", "a b c a b c", "a a a a", "a a a a a b", "x\nx\n\n \nx y\nx ", "#|<&> *%$ é ö 😀",
              "one two three four one two three five", "a\x1cb c\x85d", "a b c d a b x a b c"]:
        assert measure(t) == plain(t), t


def test_query_against_plain_python(spark, sf):
    got = queries.QUERIES["op8_quality_rules"](spark, sf).toPandas().set_index("doc_id").sort_index()
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id").set_index("doc_id")
    m = pd.DataFrame([measure(t) for t in docs.text], columns=list(quality_rules.STATS), index=docs.index)
    for i in list(docs.index)[:40]:
        assert tuple(m.loc[i]) == plain(docs.text[i]) or len(docs.text[i]) > 15000
    base = (m.n_words < 50) | (100 * m.n_repeat_words > 50 * m.n_words)
    s = RuleSettings()
    d = pd.DataFrame({"lang": docs.lang, "source": docs.source, "symbols": 1000 * m.n_symbols // m.word_chars.clip(lower=1),
                      "dup_lines": 1000 * m.n_dup_lines // m.n_lines.clip(lower=1),
                      "repeats": 1000 * m.n_repeat_words // m.n_words.clip(lower=1),
                      "word_length": 10 * m.word_chars // m.n_words.clip(lower=1)})[~base]

    def fence(values, name):
        v = sorted(min(x, 1000) for x in values)
        at = lambda q: v[-(-q * len(v) // 100) - 1]
        return at(75) + s.spread * (at(75) - at(25)) + s.slack[name]

    for i in docs.index:
        if base[i]:
            assert got.base_failed[i] and not got.kept[i]
            continue
        broken = []
        for name in s.slack:
            groups = [d[(d.lang == docs.lang[i]) & (d.source == docs.source[i])], d[d.lang == docs.lang[i]]]
            rows = next((g for g in groups if len(g) >= s.min_group), d)
            if d[name][i] > fence(rows[name], name):
                broken.append(name)
        assert got.failed[i] == ",".join(broken) and got.kept[i] == (not broken)


def test_thresholds_follow_the_group(make_docs):
    """Words that are short in one language are long in another; each has its own fence."""
    short = [(i, " ".join(f"w{i}{k}" for k in range(60)), "xx", "s") for i in range(40)]
    long = [(100 + i, " ".join(f"longerword{i}number{k}" for k in range(60)), "yy", "s") for i in range(40)]
    rows = short + long + [(999, " ".join(f"longerword{k}number{k}" for k in range(60)), "xx", "s")]
    got = {r.doc_id: r for r in apply_rules(make_docs(rows), settings=RuleSettings(min_group=20)).collect()}
    assert not got[999].kept and got[999].failed == ["word_length"]
    assert all(r.kept for i, r in got.items() if i != 999)


def test_long_words_have_fences_of_their_own(make_docs):
    """Scripts without blanks: a line is one word of some hundred or thousand characters."""
    rows = []
    for lang, size in (("ja", 150), ("th", 3000), ("zh", 400_000 // 60)):
        rows += [(len(rows) + i, " ".join(chr(0x4e00 + i * 61 + k) * (size + i) for k in range(60)), lang, "s") for i in range(40)]
    rows.append((999, " ".join("x" * 400 + str(k) for k in range(60)), "ja", "s"))
    got = {r.doc_id: r for r in apply_rules(make_docs(rows), settings=RuleSettings(min_group=20)).collect()}
    assert got[999].failed == ["word_length"]
    assert all(r.kept for i, r in got.items() if i != 999)


def test_buckets_are_exact_or_narrow(spark):
    values = [0, 1, 1000, 4095, 4096, 4097, 8191, 8192, 123_456, 10**9, 10**15]
    rows = spark.createDataFrame([(v,) for v in values], "v LONG").select("v", quality_rules.bucket(F.col("v")).alias("b")).collect()
    for v, b in rows:
        assert b == v if v < 4096 else v <= b <= v * (1 + 1 / 2048)


def test_odd_rows(odd, none):
    clash = odd.withColumn("kept", F.lit("old")).withColumn("symbols", F.lit(3)).withColumn("_lang", F.lit(4))
    got = apply_rules(clash)
    assert got.columns == [*odd.columns, "symbols", "_lang", *quality_rules.STATS, "base_failed", "failed", "kept"]
    rows = got.collect()
    assert len(rows) == odd.count() and not any(r.kept for r in rows)
    assert {r.n_words for r in rows if r.text is None} == {0}
    assert apply_rules(none).count() == 0
