"""Clustering, scoring, tagging and ranking queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.operators import cluster, core, ranking, scoring, tagging
from linkloom.plans import front_page as fp
from linkloom.plans import rescore
from linkloom.plans import stories as st

from linkloom.session import staged
from linkloom.sources.derived import table

from .registry import CFG, joined, query, r6, scrapes, secs
from .sqlbase import SINGLE, TERMS, age, assemble, cte, scan_ctes


def stories_of(spark, d):
    return st.build_stories(scrapes(spark, d), CFG)


def staged_stories(spark, d):
    """For queries that read the stories more than once."""
    return staged(stories_of(spark, d), "stories")


@query("front_page", assemble(
    """SELECT position, story_id, url, title, epoch(date)::BIGINT AS date_s,
              round(score, 6) AS score, round(aged_score, 6) AS aged_score,
              array_to_string(tags, ',') AS tags, n_scrapes FROM hot""", "hot"))
def front_page(spark, d):
    hot = fp.front_page(stories_of(spark, d), CFG)
    return hot.select(
        F.col("position").cast("bigint").alias("position"), "story_id", "url", "title",
        secs("date").alias("date_s"), r6("score").alias("score"),
        r6("aged_score").alias("aged_score"), joined("tags").alias("tags"), "n_scrapes")


@query("stories", assemble(
    """SELECT shard, story_id, url, host, url_norm, title, epoch(date)::BIGINT AS date_s,
              round(score, 6) AS score, array_to_string(tags, ',') AS tags, n_scrapes
       FROM stories""", "stories"))
def stories(spark, d):
    return stories_of(spark, d).select(
        F.col("shard").cast("bigint").alias("shard"), "story_id", "url", "host", "url_norm",
        "title", secs("date").alias("date_s"), r6("score").alias("score"),
        joined("tags").alias("tags"), "n_scrapes")


@query("clusters", assemble(
    """SELECT url_norm, anchor, count(*) AS n, epoch(min(date))::BIGINT AS earliest_s,
              min(scrape_id) AS first_id FROM clustered GROUP BY ALL""", "clustered"))
def clusters(spark, d):
    rows = core.core_rows(scrapes(spark, d), CFG)
    return (cluster.assign_clusters(rows, CFG).groupBy("url_norm", "anchor")
            .agg(F.count(F.lit(1)).alias("n"), secs(F.min("date")).alias("earliest_s"),
                 F.min("scrape_id").alias("first_id"))
            .withColumn("anchor", F.col("anchor").cast("bigint")))


def _copies(spark, d):
    """Each sighting three times under one id per page and month, in arrival order."""
    rows = scrapes(spark, d)
    return (rows.withColumn("scrape_id", F.concat_ws(
        "-", "source", F.regexp_extract("url", "([0-9]+)", 1)))
        .withColumn("comments", F.col("comments").cast("int")))


cte("copies", """
    SELECT * REPLACE (source || '-' || regexp_extract(url, '([0-9]+)', 1) AS scrape_id)
    FROM scrapes""", "scrapes")
for _policy, _order in (("first", "seq"), ("last", "seq DESC")):
    _sql = assemble(
        f"""SELECT shard, scrape_id, seq, raw_title, comments FROM (
              SELECT *, row_number() OVER (PARTITION BY shard, scrape_id ORDER BY {_order}) rn
              FROM copies) WHERE rn = 1""", "copies")

    def _run(spark, d, policy=_policy):
        out = cluster.dedup(_copies(spark, d), ["shard", "scrape_id"], policy)
        return out.select(F.col("shard").cast("bigint").alias("shard"), "scrape_id", "seq",
                          "raw_title", F.col("comments").cast("bigint").alias("comments"))

    query(f"dedup_{_policy}", _sql)(_run)


@query("dedup_max", assemble(
    """SELECT shard, scrape_id, last_seq AS seq,
              CASE WHEN source = 'feed' THEN NULL ELSE c END AS comments,
              CASE WHEN source = 'hacker_news' THEN p END AS points,
              CASE WHEN source IN ('reddit', 'lobsters') THEN s END AS score,
              CASE WHEN source = 'reddit' THEN pos ELSE last_pos END AS position
       FROM (SELECT shard, scrape_id, any_value(source) AS source, max(seq) AS last_seq,
                    max(comments) AS c, max(points) AS p, max(score) AS s,
                    max(position) AS pos, arg_max(position, seq) AS last_pos
             FROM copies GROUP BY shard, scrape_id)""", "copies"))
def dedup_max(spark, d):
    out = cluster.dedup(_copies(spark, d), ["shard", "scrape_id"], "max")
    return out.select(F.col("shard").cast("bigint").alias("shard"), "scrape_id", "seq",
                      *[F.col(c).cast("bigint").alias(c)
                        for c in ("comments", "points", "score", "position")])


@query("core_rows", assemble(
    """SELECT scrape_id, title, url, epoch(date)::BIGINT AS date_s, rank,
              array_to_string(core_tags, ',') AS core_tags FROM core""", "core"))
def core_rows(spark, d):
    return core.core_rows(scrapes(spark, d), CFG).select(
        "scrape_id", "title", "url", secs("date").alias("date_s"),
        F.col("rank").cast("bigint").alias("rank"), joined("core_tags").alias("core_tags"))


@query("title_tags", assemble(
    """SELECT scrape_id, array_to_string(core_tags, ',') AS tags FROM core
       WHERE source = 'hacker_news' AND len(core_tags) > 0""", "core"))
def title_tags(spark, d):
    tags = core.hacker_news_title_tags(F.col("raw_title"))
    return (scrapes(spark, d).where("source = 'hacker_news'")
            .select("scrape_id", tags.alias("t")).where(F.size("t") > 0)
            .select("scrape_id", joined("t").alias("tags")))


@query("tag_filters", assemble(
    """SELECT source, tag, count(*) AS n
       FROM (SELECT source, unnest(core_tags) AS tag FROM core
             WHERE source IN ('reddit', 'slashdot', 'lobsters')) GROUP BY ALL""", "core"))
def tag_filters(spark, d):
    rows = core.core_rows(scrapes(spark, d), CFG).where(
        F.col("source").isin("reddit", "slashdot", "lobsters"))
    return (rows.select("source", F.explode("core_tags").alias("tag"))
            .groupBy("source", "tag").agg(F.count(F.lit(1)).alias("n")))


# Links of which some point back at the source's own comment page.
_LINK_SQL = """CASE WHEN seq % 3 = 0 THEN CASE source
      WHEN 'hacker_news' THEN 'https://news.ycombinator.com/item?id=' || id
      WHEN 'reddit' THEN 'https://old.reddit.com/r/x/comments/' || id || '/'
      WHEN 'lobsters' THEN 'https://lobste.rs/s/' || id
      WHEN 'slashdot' THEN 'https://tech.slashdot.org/story/' || (seq + 1) ELSE url END
    ELSE url END"""


@query("self_posts", assemble(
    f"""SELECT source, count(*) AS n, sum(CASE WHEN
          (source = 'hacker_news' AND suffix(h, 'news.ycombinator.com')
           OR source = 'reddit' AND suffix(h, 'reddit.com')
           OR source = 'lobsters' AND suffix(h, 'lobste.rs')
           OR source = 'slashdot' AND suffix(h, 'slashdot.org'))
          AND contains(link, id) THEN 1 ELSE 0 END)::BIGINT AS n_self
        FROM (SELECT *, regexp_extract(link, '://([^/]*)', 1) AS h
              FROM (SELECT *, {_LINK_SQL} AS link FROM scrapes)) GROUP BY source""", "scrapes"))
def self_posts(spark, d):
    rows = scrapes(spark, d).withColumn("url", F.expr(_LINK_SQL))
    return (core.core_rows(rows, CFG).groupBy("source")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.col("self_post").cast("bigint")).alias("n_self")))


@query("score_terms", assemble(" UNION ALL ".join(
    f"SELECT scrape_id, '{n}' AS reason, round({t}, 6) AS value FROM core WHERE {t} IS NOT NULL"
    for n, t in TERMS.items()), "core"))
def score_terms(spark, d):
    rows = core.core_rows(scrapes(spark, d), CFG)
    out = scoring.scrape_term_rows(rows, CFG.score, ["scrape_id"])
    return out.select("scrape_id", "reason", r6("value").alias("value"))


@query("score_total", assemble(
    f"SELECT scrape_id, round({SINGLE}, 6) AS single_score FROM core", "core"))
def score_total(spark, d):
    return st.scored_core(scrapes(spark, d), CFG).select(
        "scrape_id", r6("single_score").alias("single_score"))


@query("best_scrapes", assemble(
    """SELECT url_norm, anchor, source, scrape_id, round(single_score, 6) AS single_score
       FROM best""", "best"))
def best_scrapes(spark, d):
    return best_of(spark, d).select(
        "url_norm", F.col("anchor").cast("bigint").alias("anchor"), "source", "scrape_id",
        r6("single_score").alias("single_score"))


def best_of(spark, d):
    rows = cluster.assign_clusters(st.scored_core(scrapes(spark, d), CFG), CFG)
    best = rows.groupBy("url_norm", "anchor", "source").agg(
        F.max(F.struct("single_score", "scrape_id", F.struct(*rows.columns).alias("row")))
        .alias("b"))
    return best.select("b.row.*")


_DETAIL = " UNION ALL ".join(
    [f"SELECT story_id, '' AS source, 'Age' AS reason,"
     f" round({age('(SELECT max(date) FROM evaluated)', 'date')}, 6) AS value FROM evaluated",
     "SELECT story_id, '', 'Random', round(((('0x' || substr(md5(url_norm), 1, 13))::BIGINT)"
     " % 6000000) / 1000000.0::DOUBLE, 6) FROM evaluated",
     "SELECT story_id, '', 'SourceCount', round(pow(n_scrapes, 1.2) * 5.0, 6) FROM evaluated",
     "SELECT story_id, '', 'LongTitle', -15.0 FROM evaluated WHERE strlen(title) > 250"]
    + [f"SELECT e.story_id, b.source, '{n}', round({t.replace('host', 'b.host').replace('title', 'b.title')}, 6)"
       f" FROM best b JOIN evaluated e USING (url_norm, anchor) WHERE"
       f" ({t.replace('host', 'b.host').replace('title', 'b.title')}) IS NOT NULL"
       for n, t in TERMS.items()])


@query("score_detail", assemble(_DETAIL, "evaluated", "best"))
def score_detail(spark, d):
    rows = cluster.assign_clusters(st.scored_core(scrapes(spark, d), CFG), CFG)
    detail = st.score_breakdown(rows, CFG)
    return detail.select("story_id", F.coalesce("source", F.lit("")).alias("source"), "reason",
                         r6("value").alias("value"))


@query("age_scores", assemble(
    f"""SELECT o_orderkey AS k, round({age("TIMESTAMP '2001-08-01'", 'o_orderdate')}, 6) AS age
        FROM orders"""))
def age_scores(spark, d):
    now = F.lit("2001-08-01").cast("timestamp")
    hours = scoring.age_hours(now, F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), r6(scoring.age_score(hours, CFG.score)).alias("age"))


cte("titles", r"""
    SELECT scrape_id, title, contains(lower(title), 'c++') AS s1,
           contains(lower(title), '***') AS s2, contains(lower(title), '%%%') AS s3,
           list_filter(list_transform(regexp_split_to_array(
             replace(replace(replace(replace(lower(title), '''s', ''), '%%%', ' '), '***', ' '),
                     'c++', ' '), '[ \t\n\r\f]+'),
             lambda w: regexp_replace(w, '[^\p{L}\p{N}-]', '', 'g')), lambda w: w <> '') AS w
    FROM core""", "core")
scan_ctes("titles", "scrape_id", "walk")


@query("title_tagging", assemble(
    """SELECT scrape_id, array_to_string(list_sort(list_distinct(found)), ',') AS tags
       FROM walk_tags""", "walk_tags"))
def title_tagging(spark, d):
    rows = core.core_rows(scrapes(spark, d), CFG)
    return rows.select(
        "scrape_id", joined(tagging.title_tags(F.col("title"), CFG.tags)).alias("tags"))


_KNOWN = ("'***','%%%','c++','anvil','bolt','bolts','cplusplus','gear','gizmo','gizmos','go',"
          "'golang','java','new-gear','percent','plate','ring','ringtag','stars','steel','web',"
          "'widget'")


@query("tag_lookup", f"""
    WITH words AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part
                   UNION ALL SELECT unnest(['Go', 'C++', 'golang', 'Gizmos', '***']) )
    SELECT word, CASE WHEN lower(word) NOT IN ({_KNOWN}) THEN NULL ELSE
             CASE lower(word) WHEN 'c++' THEN 'cplusplus' WHEN 'go' THEN 'golang'
               WHEN '***' THEN 'stars' WHEN 'gizmos' THEN 'gizmo' WHEN 'ring' THEN 'ringtag'
               WHEN 'plate' THEN 'anvil' WHEN 'bolts' THEN 'bolt' ELSE lower(word) END END AS tag,
           count(*) AS n
    FROM words GROUP BY ALL""")
def tag_lookup(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    more = spark.range(1).select(F.explode(F.array(
        *[F.lit(w) for w in ("Go", "C++", "golang", "Gizmos", "***")])).alias("word"))
    mapped = tagging.internal_tag(CFG.tags)
    return (words.unionByName(more).select("word", mapped(F.col("word")).alias("tag"))
            .groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n")))


@query("tag_display", assemble(
    """SELECT shown, count(*) AS n FROM (
         SELECT CASE t WHEN 'cplusplus' THEN 'c++' WHEN 'golang' THEN 'go'
                  WHEN 'stars' THEN '***' WHEN 'percent' THEN '%%%' WHEN 'ringtag' THEN 'ring'
                  ELSE lower(t) END AS shown
         FROM (SELECT unnest(tags) AS t FROM stories)) GROUP BY ALL""", "stories"))
def tag_display(spark, d):
    tags = stories_of(spark, d).select(F.explode("tags").alias("t"))
    return (tags.select(tagging.display_tag(F.col("t"), CFG.tags).alias("shown"))
            .groupBy("shown").agg(F.count(F.lit(1)).alias("n")))


SHOWN = """CASE t WHEN 'cplusplus' THEN 'c++' WHEN 'golang' THEN 'go' WHEN 'stars' THEN '***'
           WHEN 'percent' THEN '%%%' WHEN 'ringtag' THEN 'ring' ELSE lower(t) END"""


@query("rendered", assemble(
    f"""SELECT position AS "order", story_id AS id, host AS domain,
              array_to_string(list_concat([host], list_transform(tags, lambda t: {SHOWN})), ',')
                AS tags FROM hot""", "hot"))
def rendered(spark, d):
    hot = fp.front_page(stories_of(spark, d), CFG)
    out = ranking.render(hot, CFG.tags)
    return out.select(F.col("order").cast("bigint").alias("order"), "id", "domain",
                      joined("tags").alias("tags"))


@query("pinned_hot_set", assemble(
    """SELECT row_number() OVER (ORDER BY pinned DESC, k, score DESC, date DESC, story_id) - 1
                AS position, story_id, pinned FROM (
         SELECT *, url = (SELECT min(url) FROM hot) AS pinned,
                CAST(trunc(aged_score * -1000.0) AS INTEGER) AS k,
                row_number() OVER (PARTITION BY url = (SELECT min(url) FROM hot)
                                   ORDER BY score DESC, date DESC, story_id) AS rn
         FROM hot) WHERE NOT pinned OR rn = 1""", "hot"))
def pinned_hot_set(spark, d):
    candidates = ranking.front_page_candidates(stories_of(spark, d), CFG.hot_set_size)
    url = candidates.agg(F.min("url")).scalar()
    hot = ranking.hot_set(candidates, CFG, url)
    return hot.select(F.col("position").cast("bigint").alias("position"), "story_id", "pinned")


@query("score_tuner", assemble(
    """SELECT story_id, round(score, 6) AS stored, round(score - jit, 6) AS fresh,
              row_number() OVER (ORDER BY round(score - jit, 6) DESC, story_id) AS place
       FROM (SELECT *, ((('0x' || substr(md5(url_norm), 1, 13))::BIGINT) % 6000000)
                       / 1000000.0::DOUBLE AS jit FROM candidates)""", "candidates"))
def score_tuner(spark, d):
    fresh_cfg = CFG.but(score=replace(CFG.score, jitter=False))
    all_scrapes = scrapes(spark, d)
    front = ranking.front_page_candidates(st.build_stories(all_scrapes, CFG), CFG.hot_set_size)
    out = rescore.score_tuner(front, st.story_links(all_scrapes, CFG), all_scrapes, fresh_cfg)
    # Place by the rounded score: the two engines' powers differ in the last bit.
    place = Window.orderBy(F.desc(r6("score")), F.asc("story_id"))
    return out.select("story_id", r6("stored_score").alias("stored"), r6("score").alias("fresh"),
                      F.row_number().over(place).cast("bigint").alias("place"))


@query("paged", assemble(
    """SELECT row_number() OVER (ORDER BY date DESC, story_id) - 1 AS position, story_id
       FROM (SELECT * FROM stories ORDER BY date DESC, story_id LIMIT 30 OFFSET 120)""", "stories"))
def paged(spark, d):
    out = ranking.page(stories_of(spark, d), [F.desc("date"), F.asc("story_id")], 120, 30)
    return out.select(F.col("position").cast("bigint").alias("position"), "story_id")


@query("sorted_by", assemble(
    " UNION ALL ".join(f"""SELECT '{key}' AS key, story_id, place FROM (
       SELECT story_id, row_number() OVER (ORDER BY {order}, story_id) - 1 AS place FROM hot)"""
       for key, order in (("date", "date DESC"), ("score", "score DESC"), ("domain", "host"),
                          ("title", "title"), ("order", "position"))), "hot"))
def sorted_by(spark, d):
    """Every sort key; the place is the row's place in the sorted result."""
    hot = staged(fp.front_page(stories_of(spark, d), CFG), "hot")
    out = None
    for key in ranking.SORT_KEYS:
        # The hot set is one sorted partition here, so the id is the place.
        rows = ranking.sorted_by(hot, key).coalesce(1).select(
            F.lit(key).alias("key"), "story_id", F.monotonically_increasing_id().alias("place"))
        out = rows if out is None else out.unionByName(rows)
    # A partition of a union has an id range of its own.
    return out.withColumn("place", F.col("place") % (1 << 33))


@query("top_k", assemble(
    """SELECT story_id, round(score, 6) AS score FROM stories
       ORDER BY round(score, 6) DESC, story_id LIMIT 300""", "stories"))
def top_k(spark, d):
    rows = stories_of(spark, d).select("story_id", r6("score").alias("score"))
    return ranking.top_k(rows, "score", "story_id", CFG.max_count)


@query("score_order", assemble(
    """SELECT story_id, row_number() OVER (ORDER BY s NULLS FIRST, date, story_id) AS place
       FROM (SELECT story_id, date, CASE WHEN n_scrapes > 3 THEN NULL ELSE round(score, 6) END s
             FROM candidates)""", "candidates"))
def score_order(spark, d):
    rows = ranking.front_page_candidates(stories_of(spark, d), CFG.hot_set_size).select(
        "story_id", "date", F.when(F.col("n_scrapes") > 3, F.lit(float("nan")))
        .otherwise(r6("score")).alias("score"))
    order = Window.orderBy(*ranking.compare_score_order(), "story_id")
    return rows.select("story_id", F.row_number().over(order).cast("bigint").alias("place"))
