"""Matching and ranking stories for one search.

Relevance is BM25 per field and month. A search names only a handful of terms, so no list of
hits is kept: the collection figures of just these terms, a row per month (65 536 at most), are
broadcast, and one scan scores the rows against them. Over a stored table the figures come from
its table of figures (``figures.py``), and the scan reads the months that can hold hits; for any
other rows one aggregate over all of them finds the figures, so rows that are costly to compute
should be staged first.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig, TagConfig
from ..functions import text, urls
from ..session import settled
from . import tagging
from .figures import figure

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Term:
    """One token looked up in the given fields, with a boost per field."""

    token: str
    boosts: dict = field(default_factory=dict)  # "title" / "tags" -> boost


@dataclass(frozen=True)
class HostPhrase:
    domain: str
    boost: float = 1.0


def _tag_tokens() -> Column:
    return text.text_tokens(F.array_join("tags", " "))


def _occurrences(field_: str, token: str) -> Column:
    """How often a field holds the term. A tag with other characters than letters and digits
    (``raspberry-pi``, ``c++``) counts as a whole entry of the tags, and in a title as the run
    of its tokens; without any token (``***``) it is looked up in the tags alone."""
    parts = split_tokens(token, distinct=False)
    if parts == [token]:
        return F.size(F.filter(F.col(f"_t_{field_}"), lambda t: t == token))
    if field_ == "tags":
        return F.size(F.filter("tags", lambda t: F.lower(t) == token))
    # A run of one token would find the plain word: "c++" is not "c".
    if len(parts) < 2:
        return F.lit(0)
    text_ = F.concat(F.lit("  "), F.array_join(f"_t_{field_}", "  "), F.lit("  "))
    return F.size(F.split(text_, F.lit(" \\Q" + " " + "  ".join(parts) + " " + "\\E "), -1)) - 1


def _bm25(tf: Column, length: Column, df: Column, n: Column, total_len: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * length * n / F.greatest(total_len, F.lit(1)))
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)


def _plain(token: str) -> bool:
    return split_tokens(token, distinct=False) == [token]


def _month_rows(stories: DataFrame, stored: DataFrame, terms: list[Term], phrases: list[HostPhrase],
                most: int | None) -> list:
    """The figures of the months that the search has to read, newest first: a row per month.

    How many stories match is not known, only that it is as many as match the commonest term at least.
    With ``most``, months are taken until that many are certain.
    """
    found: dict[str, Column] = {}
    runs: dict[str, list[str]] = {}
    wanted = F.col("field") == "total"
    for i, t in enumerate(terms):
        for f in t.boosts:
            name, parts = f"_tf_{f}_{i}_df", split_tokens(t.token, distinct=False)
            field_ = f if _plain(t.token) else "entry"
            if f == "title" and not _plain(t.token):
                # A run of words: months that hold all of them may hold it.
                runs[name] = parts if len(parts) > 1 else []
                counts = [figure("title", F.lit(x)) for x in runs[name]]
                found[name] = F.least(*counts) if counts else F.lit(0).cast("bigint")
                wanted = wanted | ((F.col("field") == "title") & F.col("token").isin(parts))
                continue
            found[name] = figure(field_, F.lit(t.token))
            wanted = wanted | ((F.col("field") == field_) & (F.col("token") == t.token))
    for i, p in enumerate(phrases):
        found[f"_tf_host_{i}_df"] = figure("host", _phrase(p.domain), like=True)
        wanted = wanted | ((F.col("field") == "host") & F.col("token").contains(_phrase(p.domain)))
    totals = [figure("total", F.lit(x)).alias(y) for x, y in (
        ("stories", "_n"), ("title", "_sum_title"), ("tags", "_sum_tags"), ("host", "_sum_host"))]
    rows = (stored.where(wanted).groupBy("shard").agg(*totals, *[c.alias(n) for n, c in found.items()])
            .where(F.greatest(F.lit(0), F.lit(0), *found) > 0).orderBy(F.desc("shard")).collect())
    rows = [r.asDict() for r in rows]
    if any(runs.values()):
        months = sorted({r["shard"] for r in rows if any(r[n] for n, parts in runs.items() if parts)})
        titled = stories.where(F.col("shard").isin(months)).withColumn("_t_title", text.text_tokens(F.col("title")))
        by_name = {n: t.token for i, t in enumerate(terms) for n in [f"_tf_title_{i}_df"] if runs.get(n)}
        exact = {r["shard"]: r for r in titled.groupBy("shard").agg(*[
            F.sum((_occurrences("title", token) > 0).cast("bigint")).alias(n) for n, token in by_name.items()]).collect()}
        for r in rows:
            for n in by_name:
                r[n] = exact[r["shard"]][n] if r["shard"] in exact else 0
        rows = [r for r in rows if any(r[n] for n in found)]
    certain, out = 0, []
    for r in rows:
        if most is not None and certain >= most:
            break
        out.append(r)
        certain += max(r[n] for n in found)
    return out


def _figures_of(rows: DataFrame, tf: dict[str, Column], hit: Column, most: int | None) -> DataFrame:
    """The figures of rows that have none stored, a row per month."""
    figures = rows.groupBy("shard").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_len_{f}").alias(f"_sum_{f}") for f in ("title", "tags", "host")],
        *[F.sum((F.col(c) > 0).cast("bigint")).alias(f"{c}_df") for c in tf],
        F.sum(hit.cast("bigint")).alias("_hits"))
    if most is not None:
        # One row per month, so the one-partition window is small.
        newer = Window.orderBy(F.desc("shard")).rowsBetween(Window.unboundedPreceding, -1)
        figures = (figures.withColumn("_newer", F.coalesce(F.sum("_hits").over(newer), F.lit(0)))
                   .where((F.col("_newer") < most) & (F.col("_hits") > 0)))
    return figures


def _as_table(stories: DataFrame, known: list[dict], tf: dict[str, Column]) -> DataFrame:
    names = ["_n", "_sum_title", "_sum_tags", "_sum_host", *[f"{c}_df" for c in tf]]
    return stories.sparkSession.createDataFrame(
        [(r["shard"], *[r[n] for n in names]) for r in known], "shard INT, " + ", ".join(f"{n} BIGINT" for n in names))


def relevance(stories: DataFrame, terms: list[Term], phrases: list[HostPhrase] = (),
              most: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Stories that match any term or phrase, with ``relevance``. ``stored`` are the figures
    kept beside the table of ``stories``.

    ``most`` keeps only the newest months that together hold the first ``most`` hits of a
    month-major order. The months come from the figures, so the scoring scan of a
    partitioned table is pruned to them and every row of that order is still there.
    """
    known = None
    if stored is not None:
        known = _month_rows(stories, stored, terms, list(phrases), most)
        stories = stories.where(F.col("shard").isin([r["shard"] for r in known]))
    rows = stories.withColumns({
        "_t_title": text.text_tokens(F.col("title")), "_t_tags": _tag_tokens(),
        "_host": urls.host_phrase(F.col("host"))})
    tf: dict[str, Column] = {}
    for i, t in enumerate(terms):
        for f in t.boosts:
            tf[f"_tf_{f}_{i}"] = _occurrences(f, t.token)
    for i, p in enumerate(phrases):
        tf[f"_tf_host_{i}"] = _phrase_count(p.domain)
    rows = rows.withColumns({
        **tf, "_len_title": F.size("_t_title"), "_len_tags": F.size("_t_tags"),
        "_len_host": F.size(urls.host_tokens(F.col("host")))})
    hit = reduce(lambda a, b: a | b, [F.col(c) > 0 for c in tf], F.lit(False))
    # One settled column decides: a filter over a column per term is pushed down to the title and the
    # tags, which are taken apart again for each, and the optimizer's work doubles with every term.
    rows = settled(rows.withColumn("_hit", hit).drop("_t_title", "_t_tags", "_host"))
    figures = _figures_of(rows, tf, F.col("_hit"), most) if known is None else _as_table(stories, known, tf)
    matched = rows.where("_hit")
    scored = matched.join(F.broadcast(figures), "shard")

    def part(name: str, column: str) -> Column:
        return _bm25(F.col(column), F.col(f"_len_{name}"), F.col(f"{column}_df"),
                     F.col("_n"), F.col(f"_sum_{name}"))

    total = F.lit(0.0)
    for i, t in enumerate(terms):
        for f, boost in t.boosts.items():
            total = total + part(f, f"_tf_{f}_{i}") * boost
    for i, p in enumerate(phrases):
        total = total + part("host", f"_tf_host_{i}") * p.boost
    return scored.withColumn("relevance", total).select(*stories.columns, "relevance")


def _phrase(domain: str) -> Column:
    return urls.host_phrase(F.lit(domain))


def _phrase_count(domain: str) -> Column:
    return F.col("_host").contains(_phrase(domain)).cast("int")


def search_order() -> list[Column]:
    """Newest month first; inside a month by tweaked relevance."""
    return [F.desc("shard"), F.desc("rank_score"), F.desc("date"), F.asc("story_id")]


def ranked(matched: DataFrame, now: Column, max_count: int | None = 300) -> DataFrame:
    """Relevance + stored score - 1e-5 per second of age, then the newest months'
    best ``max_count`` rows (a top-k, no full sort), or all of them for None."""
    age = (F.unix_seconds(now) - F.unix_seconds("date")).cast("double")
    rows = matched.withColumn(
        "rank_score", F.round(F.col("relevance") + F.col("score") - age * 0.00001, 9)).orderBy(*search_order())
    return rows if max_count is None else rows.limit(max_count)


def by_tag(stories: DataFrame, tag: str, alt: str | None = None,
           most: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    tokens = list(dict.fromkeys(t.lower() for t in (tag, alt) if t))
    return relevance(stories, [Term(t.lower(), {"title": 1.0, "tags": 10.0}) for t in tokens],
                     most=most, stored=stored)


def split_tokens(phrase: str, distinct: bool = True) -> list[str]:
    out, word = [], ""
    for ch in phrase.lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return list(dict.fromkeys(out)) if distinct else out


def by_text(stories: DataFrame, phrase: str, most: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    neutral = phrase.replace("http:", "http ").replace("https:", "https ")
    return relevance(stories, [Term(t, {"title": 1.0, "tags": 3.0})
                               for t in split_tokens(neutral)], most=most, stored=stored)


def by_domain(stories: DataFrame, domain: str, most: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Host contains the domain's tokens as a run: ``co.uk`` finds ``x.y.co.uk``."""
    return relevance(stories, [], [HostPhrase(domain)], most, stored)


def by_url(stories: DataFrame, url: str) -> DataFrame:
    """Same canonical URL, given in any spelling. The string is compared, not a hash; every
    hit is equally good."""
    url = url if "://" in url else f"http://{url}"
    return (stories.where(F.col("url_norm") == urls.url_norm(F.lit(url)))
            .withColumn("relevance", F.lit(1.0)))


def related(stories: DataFrame, title: str, tags: list[str], own_url: str | None = None,
            own_date=None, max_count: int = 30, stored: DataFrame | None = None) -> DataFrame:
    """Stories that share title words or tags, by relevance inside each month.

    Title words count double in titles; tags without a dot count 0.2 in tags; tags with a
    dot are host phrases with weight 10. The story itself is left out.
    """
    plain = title.lower().replace(" the ", " ").replace(" a ", " ")
    for lead in ("the ", "a "):
        while plain.startswith(lead):
            plain = plain[len(lead):]
    boosts: dict[str, dict] = {
        t: {"title": 2.0, "tags": 1.0} for t in split_tokens(plain)}
    phrases = []
    for tag in tags:
        if "." in tag.strip("."):
            phrases.append(HostPhrase(tag, 10.0))
        else:
            entry = boosts.setdefault(tag, {})
            entry["tags"] = entry.get("tags", 0.0) + 0.2
    # One more than asked for: the story itself is among the hits.
    out = relevance(stories, [Term(t, b) for t, b in boosts.items()], phrases, max_count + 1, stored)
    if own_url is not None:
        out = out.where(~((F.col("url") == own_url) & (F.col("date") == own_date)))
    return (out.withColumn("rank_score", F.round("relevance", 9))
            .orderBy(*search_order()).limit(max_count))


def classify(searches: DataFrame, cfg: TagConfig, column: str = "search",
             own_phrase: str | None = None, own_host: str | None = None) -> DataFrame:
    """Typed query of every search string: ``kind``, ``text``, ``alt``.

    kind is "" (front page), tag, url, domain or text. A null search is the front page;
    the reserved ``own_phrase`` becomes a domain search of the site's own host.
    """
    raw = F.trim(F.coalesce(F.col(column), F.lit("")))
    own = raw == own_phrase if own_phrase is not None else F.lit(False)
    staged = searches.withColumn("_s", raw)
    mapped = tagging.internal_tag(cfg)
    staged = staged.withColumn("_tag", mapped(F.col("_s")))
    s = F.col("_s")
    as_url = F.when(s.contains(":"), s).otherwise(F.concat(F.lit("http://"), s))
    staged = (staged
              .withColumn("_host", F.when(s.contains(".") | s.contains(":"), urls.host(as_url)))
              .withColumn("_norm", urls.url_norm(as_url)))
    host = F.col("_host")
    usable = (host.isNotNull() & ~host.rlike(r"[^\p{L}\p{N}.-]") & host.rlike(r"[\p{L}\p{N}-]"))
    kind = (F.when(own, "domain").when(~s.rlike(r"[\p{L}\p{N}]"), "")
            .when(F.col("_tag").isNotNull(), "tag")
            .when(usable & s.contains("/"), "url")
            .when(usable, "domain")
            .when(~s.rlike(r"[^\p{L}\p{N}]"), "tag")
            .otherwise("text"))
    staged = staged.withColumn("kind", kind)
    known = F.col("_tag").isNotNull()
    return (staged
            .withColumn("text", F.when(own, F.lit(own_host)).when(F.col("kind") == "", "")
                        .when(F.col("kind") == "tag", F.coalesce("_tag", F.lower("_s")))
                        .when(F.col("kind") == "url", F.col("_norm"))
                        .when(F.col("kind") == "domain", host).otherwise(s))
            .withColumn("alt", F.when((F.col("kind") == "tag") & known
                                      & (F.lower("_tag") != F.lower("_s")), F.lower("_s")))
            .drop("_s", "_tag", "_host", "_norm"))


def run(stories: DataFrame, kind: str, query: str, alt: str | None, now: Column,
        cfg: EngineConfig = EngineConfig(), stored: DataFrame | None = None) -> DataFrame:
    """Execute one classified search; ``stored`` are the figures kept beside the stories."""
    if kind == "tag":
        hits = by_tag(stories, query, alt, cfg.max_count, stored)
    elif kind == "url":
        hits = by_url(stories, query)
    elif kind == "domain":
        hits = by_domain(stories, query, cfg.max_count, stored)
    elif kind == "text":
        hits = by_text(stories, query, cfg.max_count, stored)
    else:
        raise ValueError("the front page is a job of its own")
    return ranked(hits, now, cfg.max_count)


def matches(stories: DataFrame, kind: str, query: str, alt: str | None = None) -> DataFrame:
    """Rows a search matches, unranked and without the collection figures."""
    title, tags = text.text_tokens(F.col("title")), _tag_tokens()
    if kind == "":
        return stories
    if kind == "url":
        return by_url(stories, query).drop("relevance")
    if kind == "domain":
        return stories.where(urls.host_phrase(F.col("host")).contains(_phrase(query)))
    if kind == "tag":
        terms = list(dict.fromkeys(t.lower() for t in (query, alt) if t))
        rows = stories.withColumns({"_t_title": title, "_t_tags": tags})
        hit = reduce(lambda a, b: a | b, [_occurrences(f, t) > 0 for t in terms for f in ("title", "tags")])
        return rows.where(hit).drop("_t_title", "_t_tags")
    if kind != "text":
        raise ValueError(f"{kind!r} has no hit count")
    wanted = F.array(*[F.lit(t) for t in split_tokens(query)]).cast("array<string>")
    return stories.where(F.arrays_overlap(F.concat(title, tags), wanted))
