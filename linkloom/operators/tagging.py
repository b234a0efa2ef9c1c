"""Tagging titles from a dictionary, and mapping tags to and from their shown form.

The dictionary is configuration, so it travels as one literal: an array of buckets by the
hash of an entry's first word. A title is tagged inside its own row, with no join, no
shuffle and no Python; each word costs one bucket lookup.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TagConfig

_QUOTES = "`‘’‚‛"

# Scan order of hits at one position.
EXCLUDE, MULTI, WORD = 0, 1, 2


def spellings(tag: str) -> list[str]:
    """Expand ``(-)`` to hyphen and space and ``(s)`` to singular and plural."""
    if "(-)" in tag:
        return spellings(tag.replace("(-)", "-")) + spellings(tag.replace("(-)", " "))
    if tag.endswith("(s)"):
        return [tag[:-3], tag[:-3] + "s"]
    return [tag]


@dataclass(frozen=True)
class Entry:
    form: str
    kind: str  # word, multi, symbol, exclude
    output: str
    implies: tuple[str, ...]
    primary: str


def entries(cfg: TagConfig) -> list[Entry]:
    """Dictionary rows. Two entries with one spelling: the alphabetically first wins."""
    found: dict[tuple[str, str], Entry] = {}
    for tag in sorted(cfg.tags, reverse=True):
        opt = cfg.tags[tag]
        alts = ([opt["alt"]] if opt.get("alt") else []) + list(opt.get("alts", ()))
        primary = spellings(tag)[0]
        output = opt.get("internal") or primary
        implies = (opt["implies"],) if opt.get("implies") else ()
        for form in {f for t in (tag, *alts) for f in spellings(t)}:
            kind = "symbol" if opt.get("symbol") else "multi" if " " in form else "word"
            found[kind, form] = Entry(form, kind, output, implies, primary)
        for form in {f for t in opt.get("excludes", ()) for f in spellings(t)}:
            found["exclude", form] = Entry(form, "exclude", output, (), primary)
    return [found[k] for k in sorted(found)]


def shown_forms(cfg: TagConfig) -> dict[str, str]:
    """Internal tag -> shown tag, where the two differ."""
    return {o["internal"]: t for t, o in sorted(cfg.tags.items()) if o.get("internal")}


def dictionary(spark: SparkSession, cfg: TagConfig) -> DataFrame:
    """The expanded dictionary as a table, for inspection."""
    rows = [(e.form, e.kind, e.output, list(e.implies), e.primary, len(e.form.split()))
            for e in entries(cfg)]
    return spark.createDataFrame(
        rows, "form STRING, kind STRING, output STRING, implies ARRAY<STRING>, "
              "primary STRING, n_words INT")


def _buckets(rows: list[dict], key: str, schema: str) -> tuple[Column, int]:
    """Rows hashed by ``key`` into a literal ``array<array<struct>>``."""
    n = max(16, 1 << (len(rows) // 2).bit_length())
    table: list[list[dict]] = [[] for _ in range(n)]
    for row in rows:
        table[zlib.crc32(row[key].encode()) % n].append(row)
    text = json.dumps(table, ensure_ascii=False)
    return F.from_json(F.lit(text), f"array<array<{schema}>>"), n


def _bucket(table: Column, n: int, word: Column) -> Column:
    return F.element_at(table, (F.crc32(word.cast("binary")) % n + 1).cast("int"))


def lookup_terms(cfg: TagConfig) -> dict[str, str]:
    """Search word or source tag -> internal tag."""
    rows = entries(cfg)
    mapped: dict[str, str] = {i: i for i in shown_forms(cfg)}
    mapped.update({e.output: e.output for e in rows if e.kind == "symbol"})
    mapped.update({e.form: e.output for e in rows if e.kind == "word"})
    mapped.update({e.form: e.output for e in rows if e.kind == "symbol"})
    return mapped


def internal_tag(cfg: TagConfig):
    """Function from a column to its internal tag, null when the word is no tag."""
    rows = [{"term": t, "mapped": m} for t, m in sorted(lookup_terms(cfg).items())]
    table, n = _buckets(rows, "term", "struct<term:string,mapped:string>")

    def mapped(word: Column) -> Column:
        low = F.lower(word)
        hits = F.filter(_bucket(table, n, low), lambda r: r["term"] == low)
        return F.get(hits, F.lit(0))["mapped"]

    return mapped


def display_tag(tag: Column, cfg: TagConfig) -> Column:
    """Shown form of an internal tag; other tags are lower-cased."""
    out = F.lower(tag)
    for internal, shown in shown_forms(cfg).items():
        out = F.when(F.lower(tag) == internal, F.lit(shown)).otherwise(out)
    return out


def _prepared(title: Column) -> Column:
    s = F.translate(F.lower(title), _QUOTES, "'" * len(_QUOTES))
    return F.replace(s, F.lit("'s"), F.lit(""))


def _symbol_pass(text: Column, cfg: TagConfig) -> tuple[Column, Column]:
    """Replace every symbol tag by a space, longest first; also the tags so found."""
    symbols = [e for e in entries(cfg) if e.kind == "symbol"]
    symbols.sort(key=lambda e: (-len(e.form), e.form))
    empty = F.array().cast("array<string>")
    tags = [empty]
    for e in symbols:
        hit = F.array(*[F.lit(t) for t in (e.output, *e.implies)])
        tags.append(F.when(text.contains(e.form), hit).otherwise(empty))
        text = F.replace(text, F.lit(e.form), F.lit(" "))
    return text, F.flatten(F.array(*tags))


def title_words(text: Column) -> Column:
    words = F.transform(F.split(text, r"[ \t\n\r\f]+"),
                        lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}-]", ""))
    return F.filter(words, lambda w: w != "")


def _scan(hits: Column) -> Column:
    """Left-to-right scan over the sorted hits of one title; returns the tags.

    ``next`` is the first position not yet consumed, ``skipped`` counts words swallowed
    by multi-word tags, so ``pos - skipped`` is the number of the scan step. A mute holds
    for as many steps as its exclusion has words.
    """
    start = F.struct(
        F.lit(0).alias("next"), F.lit(0).alias("skipped"),
        F.array().cast("array<struct<tag:string,last:int>>").alias("mutes"),
        F.array().cast("array<string>").alias("tags"))

    def step(acc: Column, h: Column) -> Column:
        turn = h["pos"] - acc["skipped"]
        muted = F.exists(acc["mutes"], lambda m: (m["tag"] == h["form"]) & (m["last"] >= turn))
        live = h["pos"] >= acc["next"]
        is_mute = live & (h["rank"] == EXCLUDE)
        is_multi = live & (h["rank"] == MULTI)
        emits = is_multi | (live & (h["rank"] == WORD) & ~muted)
        return F.struct(
            F.when(is_multi, h["pos"] + h["n_words"]).otherwise(acc["next"]).alias("next"),
            F.when(is_multi, acc["skipped"] + h["n_words"] - 1)
            .otherwise(acc["skipped"]).alias("skipped"),
            F.when(is_mute, F.array_append(acc["mutes"], F.struct(
                h["primary"].alias("tag"), (turn + h["n_words"] - 1).cast("int").alias("last"))))
            .otherwise(acc["mutes"]).alias("mutes"),
            F.when(emits, F.concat(acc["tags"], h["emit"]))
            .otherwise(acc["tags"]).alias("tags"))

    return F.aggregate(F.sort_array(hits), start, step, lambda acc: acc["tags"])


def title_tags(title: Column, cfg: TagConfig) -> Column:
    """Sorted distinct tags of a title."""
    kinds = {"exclude": EXCLUDE, "multi": MULTI, "word": WORD}
    rows = []
    for e in entries(cfg):
        if e.kind in kinds:
            words = e.form.split()
            rows.append({
                "first": words[0], "words": words, "n_words": len(words), "form": e.form,
                "rank": kinds[e.kind], "primary": e.primary,
                "emit": list(dict.fromkeys((e.output, *e.implies)))})
    table, n = _buckets(
        rows, "first", "struct<first:string,words:array<string>,n_words:int,form:string,"
                       "rank:int,primary:string,emit:array<string>>")
    text, symbol_tags = _symbol_pass(_prepared(title), cfg)

    def hits(words: Column) -> Column:
        def at(word: Column, pos: Column) -> Column:
            fits = F.filter(_bucket(table, n, word), lambda e: (e["first"] == word) & (
                (e["n_words"] == 1) | (F.slice(words, pos + 1, e["n_words"]) == e["words"])))
            # Longest multi-word form first, then alphabetical: the order of the fields.
            return F.transform(fits, lambda e: F.struct(
                pos.cast("int").alias("pos"), e["rank"].alias("rank"),
                (-e["n_words"]).alias("neg_words"), e["form"].alias("form"),
                e["n_words"].alias("n_words"), e["primary"].alias("primary"),
                e["emit"].alias("emit")))

        return F.flatten(F.transform(words, at))

    # transform over a one-element array binds the words once for the whole scan
    scanned = F.flatten(F.transform(F.array(title_words(text)), lambda w: _scan(hits(w))))
    return F.sort_array(F.array_union(symbol_tags, scanned))


def story_tags(title: Column, source_tags: Column, cfg: TagConfig) -> Column:
    """Tags of the title together with the scrapes' own tags in internal form."""
    mapped = internal_tag(cfg)
    own = F.transform(source_tags, lambda t: F.coalesce(mapped(t), F.lower(t)))
    return F.sort_array(F.array_union(title_tags(title, cfg), own))
