"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import joins, search
from linkloom.plans import stories as st
from linkloom.plans.store import StoryStore
from linkloom.plans.story_page import story_page as page_of
from linkloom.session import shared_path
from linkloom.sources.derived import table

from .registry import CFG, query, r6, scrapes
from .sqlbase import assemble, cte, norm, story_id  # noqa: F401
from .stories import staged_stories, stories_of

_TOK = (r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'),"
        r" lambda t: t <> '')")
cte("tokens", f"""
    SELECT shard, story_id, 'title' AS f, unnest({_TOK.format(x='title')}) AS t FROM stories
    UNION ALL
    SELECT shard, story_id, 'tags', unnest({_TOK.format(x="array_to_string(tags, ' ')")})
    FROM stories
    UNION ALL
    SELECT shard, story_id, 'host', unnest({_TOK.format(x='host')}) FROM stories""", "stories")
cte("lengths", "SELECT story_id, f, count(*) AS len FROM tokens GROUP BY ALL", "tokens")
cte("month_sizes", "SELECT shard, count(*) AS n FROM stories GROUP BY shard", "stories")
cte("month_lengths", "SELECT shard, f, count(*) AS s FROM tokens GROUP BY ALL", "tokens")


def bm25(name: str, terms: list[tuple[str, str, float]], phrases=(), terms_sql=None) -> str:
    """CTE ``name`` (story_id, relevance) for (field, token, boost) rows and host phrases."""
    rows = terms_sql or "SELECT * FROM (VALUES " + ", ".join(
        f"('{f}', '{t}', {b}::DOUBLE)" for f, t, b in (terms or [("x", "x", 0.0)])
    ) + ") v(f, t, boost)"
    cte(f"{name}_q", rows, *(("top_story",) if terms_sql else ()))
    hosts = " UNION ALL ".join(
        ["SELECT k.shard, k.story_id, k.f, k.t, q.boost, count(*) AS tf"
         f" FROM tokens k JOIN {name}_q q USING (f, t) GROUP BY ALL"]
        + [f"SELECT shard, story_id, 'host', '{p}', {b}::DOUBLE, 1 FROM stories"
           f" WHERE contains(' ' || array_to_string({_TOK.format(x='host')}, ' ') || ' ',"
           f" ' ' || replace(replace('{p}', '.', ' '), '-', ' ') || ' ')" for p, b in phrases])
    if terms_sql:
        hosts += (f" UNION ALL SELECT shard, story_id, 'host', 'self', 10.0::DOUBLE, 1 FROM stories"
                  f" WHERE contains(' ' || array_to_string({_TOK.format(x='host')}, ' ') || ' ',"
                  f" ' ' || array_to_string({_TOK.format(x='(SELECT host FROM top_story)')}, ' ')"
                  f" || ' ')")
    cte(f"{name}_tf", hosts, "tokens", "stories", f"{name}_q")
    cte(name, f"""
        SELECT t.story_id, sum(t.boost * ln(1 + (m.n - d.df + 0.5) / (d.df + 0.5))
               * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.len * m.n / s.s))) AS relevance
        FROM {name}_tf t
        JOIN (SELECT shard, f, t, count(*) AS df FROM {name}_tf GROUP BY ALL) d USING (shard, f, t)
        JOIN month_sizes m USING (shard)
        JOIN month_lengths s USING (shard, f)
        JOIN lengths l ON l.story_id = t.story_id AND l.f = t.f
        GROUP BY t.story_id""", f"{name}_tf", "month_sizes", "month_lengths", "lengths")


def ranked_sql(name: str, limit: int = 300) -> str:
    return (f"SELECT story_id, shard, round(relevance, 6) AS relevance,"
            f" round(rank_score, 6) AS rank_score FROM ("
            f" SELECT s.*, r.relevance, round(r.relevance + s.score - 0.00001::DOUBLE *"
            f" (epoch((SELECT max(date) FROM stories)) - epoch(s.date)), 9) AS rank_score"
            f" FROM {name} r JOIN stories s USING (story_id))"
            f" ORDER BY shard DESC, rank_score DESC, date DESC, story_id LIMIT {limit}")


def show(rows):
    return rows.select("story_id", F.col("shard").cast("bigint").alias("shard"),
                       r6("relevance").alias("relevance"), r6("rank_score").alias("rank_score"))


def run(spark, d, kind, text, alt=None):
    stories = staged_stories(spark, d)
    return show(search.run(stories, kind, text, alt, stories.agg(F.max("date")).scalar(), CFG))


bm25("rel_tag", [("title", "ringtag", 1.0), ("tags", "ringtag", 10.0),
                 ("title", "ring", 1.0), ("tags", "ring", 10.0)])
bm25("rel_text", [(f, t, b) for t in ("small", "gizmo", "http")
                  for f, b in (("title", 1.0), ("tags", 3.0))])
bm25("rel_domain", [], [("example.net", 1.0)])


@query("search_tag", assemble(ranked_sql("rel_tag"), "rel_tag", "stories"))
def search_tag(spark, d):
    return run(spark, d, "tag", "ringtag", "ring")


@query("search_text", assemble(ranked_sql("rel_text"), "rel_text", "stories"))
def search_text(spark, d):
    return run(spark, d, "text", "Small gizmo, http:gizmo")


@query("search_domain", assemble(ranked_sql("rel_domain"), "rel_domain", "stories"))
def search_domain(spark, d):
    return run(spark, d, "domain", "example.net")


@query("search_stored", assemble(ranked_sql("rel_text"), "rel_text", "stories"))
def search_stored(spark, d):
    """The text search over a stored table, with the figures kept beside it."""
    store = StoryStore(spark, shared_path(spark, "search-store"), CFG)
    store.load(scrapes(spark, d))
    return show(store.search("text", "Small gizmo, http:gizmo"))


@query("month_figures", assemble(
    rf"""SELECT shard::BIGINT AS shard, f AS field, t AS token, count(DISTINCT story_id) AS n FROM tokens WHERE f <> 'host' GROUP BY ALL
        UNION ALL SELECT shard, 'entry', lower(tag), count(DISTINCT story_id) FROM (SELECT shard, story_id, unnest(tags) AS tag FROM stories)
          WHERE regexp_matches(lower(tag), '[^\p{{L}}\p{{N}}]') GROUP BY ALL
        UNION ALL SELECT shard, 'host', ' ' || array_to_string({_TOK.format(x='host')}, ' ') || ' ', count(*) FROM stories GROUP BY ALL
        UNION ALL SELECT shard, 'total', f, count(*) FROM tokens GROUP BY ALL
        UNION ALL SELECT shard, 'total', 'stories', count(*) FROM stories GROUP BY ALL""", "tokens", "stories"))
def month_figures(spark, d):
    """As stored after a bulk load."""
    store = StoryStore(spark, shared_path(spark, "figures-store"), CFG)
    store.load(scrapes(spark, d))
    return store.figures.select(F.col("shard").cast("bigint").alias("shard"), "field", "token", "n")


cte("url_hits", f"""
    SELECT *, round(1.0::DOUBLE + score - 0.00001::DOUBLE *
             (epoch((SELECT max(date) FROM stories)) - epoch(date)), 9) AS rank_score
    FROM stories WHERE url_norm = (SELECT {norm('url')} FROM pages WHERE page_id = 1)""", "stories")


@query("search_url", assemble(
    """SELECT story_id, shard, round(rank_score, 6) AS rank_score FROM url_hits
       ORDER BY shard DESC, rank_score DESC, date DESC, story_id LIMIT 300""", "url_hits"))
def search_url(spark, d):
    url = table(spark, d, "pages").where("page_id = 1").select("url").first().url
    return run(spark, d, "url", url).drop("relevance")


cte("top_story", "SELECT * FROM stories ORDER BY score DESC, story_id LIMIT 1", "stories")


@query("search_by_id", assemble(
    "SELECT story_id, title, host FROM top_story", "top_story"))
def search_by_id(spark, d):
    stories = staged_stories(spark, d)
    top = stories.orderBy(F.desc("score"), "story_id").select("story_id").first().story_id
    return joins.find_story(stories, top).select("story_id", "title", "host").limit(1)


_STOP = "regexp_replace(regexp_replace(replace(replace(lower(title), ' the ', ' '), ' a ', ' ')," \
        " '^(the )+', ''), '^(a )+', '')"
bm25("rel_related", [], terms_sql=rf"""
    SELECT f, t, sum(boost) AS boost FROM (
      SELECT unnest(['title', 'tags']) AS f, t, unnest([2.0::DOUBLE, 1.0::DOUBLE]) AS boost
      FROM (SELECT DISTINCT unnest({_TOK.format(x=_STOP)}) AS t FROM top_story)
      UNION ALL SELECT 'tags', unnest(tags), 0.2::DOUBLE FROM top_story) GROUP BY f, t""")


@query("related", assemble(
    """SELECT story_id, shard, round(relevance, 6) AS relevance FROM (
         SELECT s.*, r.relevance FROM rel_related r JOIN stories s USING (story_id)
         WHERE NOT (s.url = (SELECT url FROM top_story) AND s.date = (SELECT date FROM top_story)))
       ORDER BY shard DESC, round(relevance, 9) DESC, date DESC, story_id LIMIT 30""",
    "rel_related", "stories"))
def related(spark, d):
    stories = staged_stories(spark, d)
    top = stories.orderBy(F.desc("score"), "story_id").limit(1).collect()[0]
    out = search.related(stories, top.title, [top.host, *top.tags], top.url, top.date)
    return show(out).drop("rank_score")


@query("story_page", assemble(
    """SELECT 'story' AS part, story_id AS id FROM url_hits
       UNION ALL
       SELECT 'scrape', c.scrape_id FROM clustered c JOIN url_hits u USING (url_norm, anchor)""",
    "url_hits", "clustered"))
def story_page(spark, d):
    first = table(spark, d, "pages").where("page_id = 1").select("url").first()
    rows = scrapes(spark, d)
    parts = page_of(staged_stories(spark, d), st.story_links(rows, CFG), rows,
                    first.url, "example.net", CFG)
    return (parts["stories"].select(F.lit("story").alias("part"), F.col("story_id").alias("id"))
            .unionByName(parts["scrapes"].select(
                F.lit("scrape").alias("part"), F.col("scrape_id").alias("id"))))


@query("hits_or_fallback", assemble(
    """SELECT 'none' AS asked, story_id FROM stories
       WHERE NOT EXISTS (SELECT 1 FROM stories WHERE url_norm = 'no.such.host/x')
       UNION ALL SELECT 'some', story_id FROM url_hits""", "stories", "url_hits"))
def hits_or_fallback(spark, d):
    """A URL nobody has falls back to all stories; one that somebody has does not."""
    stories = stories_of(spark, d).select("story_id", "url_norm", "host")
    url = table(spark, d, "pages").where("page_id = 1").select("url").first().url
    asked = {"none": "http://no.such.host/x", "some": url}
    parts = [joins.hits_or_fallback(search.by_url(stories, u).drop("relevance"), stories)
             .select(F.lit(k).alias("asked"), "story_id") for k, u in asked.items()]
    return parts[0].unionByName(parts[1])


@query("search_hyphen_tag", assemble(
    rf"""SELECT story_id FROM stories
        WHERE shard % 4 = 0 OR contains(' ' || array_to_string({_TOK.format(x='title')}, ' ') || ' ',
                                        ' small rod ')""", "stories"))
def search_hyphen_tag(spark, d):
    """A tag with a hyphen is an entry of the tags or a run of words in the title."""
    tagged = F.when(F.col("shard") % 4 == 0, F.array_append("tags", F.lit("Small-Rod"))).otherwise(F.col("tags"))
    stories = stories_of(spark, d).withColumn("tags", tagged)
    return search.matches(stories, "tag", "small-rod").select("story_id")


@query("search_own_site", assemble(
    """SELECT story_id FROM stories WHERE host = 'example.net' OR suffix(host, '.example.net')""", "stories"))
def search_own_site(spark, d):
    """The reserved phrase is a search of the site's own host."""
    asked = spark.createDataFrame([("my site",)], "search STRING")
    q = search.classify(asked, CFG.tags, own_phrase="my site", own_host="example.net").first()
    return search.matches(stories_of(spark, d), q.kind, q.text, q.alt).select("story_id")
