"""Incremental merging, lookups, upserts and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import counts, joins, quality, upsert
from linkloom.plans import merge as mg
from linkloom.plans import stories as st

from .registry import CFG, query, r6, scrapes
from .sqlbase import JITTER, SINGLE, assemble, cte, story_id

# Two sites' sightings arrive as a batch after the other three are stored.
_LATE = "('reddit', 'feed')"


def cluster_ctes(p: str, source: str) -> None:
    """Months, anchors and clustered rows of a subset of ``core``."""
    cte(f"{p}months", f"SELECT DISTINCT url_norm, shard FROM {source}", source)
    cte(f"{p}anchors_rec", f"""
        SELECT url_norm, min(shard) AS anchor FROM {p}months GROUP BY url_norm
        UNION ALL
        SELECT a.url_norm, (SELECT min(m.shard) FROM {p}months m
                            WHERE m.url_norm = a.url_norm AND m.shard > a.anchor + 2)
        FROM {p}anchors_rec a
        WHERE EXISTS (SELECT 1 FROM {p}months m
                      WHERE m.url_norm = a.url_norm AND m.shard > a.anchor + 2)""", f"{p}months")
    cte(f"{p}clustered", f"""
        SELECT c.*, (SELECT max(a.anchor) FROM {p}anchors_rec a
                     WHERE a.url_norm = c.url_norm AND a.anchor <= c.shard) AS anchor
        FROM {source} c""", source, f"{p}anchors_rec")


cte("old_core", f"SELECT * FROM core WHERE source NOT IN {_LATE}", "core")
cte("new_core", f"SELECT * FROM core WHERE source IN {_LATE}", "core")
cluster_ctes("old_", "old_core")
cluster_ctes("new_", "new_core")
cte("old_heads", f"""
    SELECT url_norm, anchor, date, year(date) * 12 + month(date) - 1 AS shard,
           {story_id('date', 'url_norm')} AS story_id
    FROM (SELECT url_norm, anchor, min(date) AS date FROM old_clustered GROUP BY ALL)""",
    "old_clustered")
cte("new_heads", """
    SELECT anchor || '#' || url_norm AS new_key, url_norm, anchor, min(date) AS date,
           year(min(date)) * 12 + month(min(date)) - 1 AS shard
    FROM new_clustered GROUP BY ALL""", "new_clustered")
cte("matched", """
    SELECT n.*, (SELECT o.story_id FROM old_heads o
                 WHERE o.url_norm = n.url_norm AND o.shard IN (n.shard, n.shard - 1)
                   AND o.date >= n.date - INTERVAL 30 DAY AND o.date < n.date + INTERVAL 30 DAY
                 ORDER BY o.shard DESC, o.date, o.story_id LIMIT 1) AS match_id
    FROM new_heads n""", "new_heads", "old_heads")


def split(spark, d):
    rows = scrapes(spark, d)
    late = F.col("source").isin("reddit", "feed")
    return rows.where(~late), rows.where(late)


@query("interval_match", assemble(
    "SELECT new_key, epoch(date)::BIGINT AS date_s, match_id FROM matched", "matched"))
def interval_match(spark, d):
    old, new = split(spark, d)
    heads = mg.collections_of(new, CFG).groupBy("new_key", "url_norm").agg(
        F.min("date").alias("date"))
    return joins.match_existing(heads, st.build_stories(old, CFG), CFG.merge_days).select(
        "new_key", F.unix_seconds("date").alias("date_s"), "match_id")


@query("unmatched", assemble(
    """SELECT 'unfound' AS side, url_norm FROM (SELECT DISTINCT url_norm FROM new_core)
       WHERE url_norm NOT IN (SELECT url_norm FROM old_core)
       UNION ALL
       SELECT 'found', url_norm FROM (SELECT DISTINCT url_norm FROM new_core)
       WHERE url_norm IN (SELECT url_norm FROM old_core)""", "old_core", "new_core"))
def unmatched(spark, d):
    from linkloom.operators.core import core_rows
    old, new = (core_rows(x, CFG).select("url_norm").distinct() for x in split(spark, d))
    return (joins.unfound(new, old, ["url_norm"]).select(F.lit("unfound").alias("side"), "url_norm")
            .unionByName(joins.found(new, old, ["url_norm"])
                         .select(F.lit("found").alias("side"), "url_norm")))


@query("hydrate", assemble(
    """SELECT e.story_id, c.scrape_id, c.comments, c.shard FROM clustered c
       JOIN evaluated e USING (url_norm, anchor)""", "clustered", "evaluated"))
def hydrate(spark, d):
    rows = scrapes(spark, d)
    return joins.hydrate(st.story_links(rows, CFG), rows).select(
        "story_id", "scrape_id", F.col("comments").cast("bigint").alias("comments"),
        F.col("shard").cast("bigint").alias("shard"))


cte("regrouped", """
    SELECT c.* EXCLUDE (anchor), h.story_id AS gk FROM old_clustered c
      JOIN old_heads h USING (url_norm, anchor)
    UNION ALL
    SELECT c.* EXCLUDE (anchor), coalesce(m.match_id, m.new_key) AS gk FROM new_clustered c
      JOIN matched m USING (url_norm, anchor)""",
    "old_clustered", "new_clustered", "old_heads", "matched")
cte("merged_stories", f"""
    SELECT r.*, {story_id('r.date', 'r.url_norm')} AS story_id,
           {JITTER} + pow(r.n_scrapes, 1.2) * 5.0
             + CASE WHEN strlen(r.title) > 250 THEN -15.0 ELSE 0.0 END + b.total AS score
    FROM (SELECT gk, url_norm, min(date) AS date, count(*) AS n_scrapes,
                 first(title ORDER BY CASE source WHEN 'hacker_news' THEN 0 WHEN 'feed' THEN 1
                       WHEN 'lobsters' THEN 2 WHEN 'slashdot' THEN 3 WHEN 'reddit' THEN 4
                       ELSE 99 END, scrape_id) AS title
          FROM regrouped GROUP BY gk, url_norm) r
    JOIN (SELECT gk, sum(s) AS total FROM (
            SELECT gk, source, max({SINGLE}) AS s FROM regrouped GROUP BY gk, source)
          GROUP BY gk) b USING (gk)""", "regrouped")


@query("incremental_merge", assemble(
    """SELECT story_id, title, epoch(date)::BIGINT AS date_s, n_scrapes, round(score, 6) AS score
       FROM merged_stories""", "merged_stories"))
def incremental_merge(spark, d):
    old, new = split(spark, d)
    stories = st.build_stories(old, CFG)
    out = mg.merge_batch(new, stories, st.story_links(old, CFG), old, CFG)
    final = upsert.replace_rows(stories, out.gone, out.changed, "story_id")
    return final.select("story_id", "title", F.unix_seconds("date").alias("date_s"), "n_scrapes",
                        r6("score").alias("score"))


@query("merge_links", assemble(
    f"""SELECT m.story_id, g.scrape_id, g.shard FROM regrouped g
        JOIN merged_stories m USING (gk, url_norm)""", "regrouped", "merged_stories"))
def merge_links(spark, d):
    old, new = split(spark, d)
    links = st.story_links(old, CFG)
    out = mg.merge_batch(new, st.build_stories(old, CFG), links, old, CFG)
    final = upsert.replace_rows(links, out.gone, out.links, "story_id")
    return final.select("story_id", "scrape_id", F.col("scrape_shard").cast("bigint").alias("shard"))


@query("insert_summary", assemble(
    """SELECT count(match_id) AS merged, 0::BIGINT AS existing,
              count(*) - count(match_id) AS new, 0::BIGINT AS not_found FROM matched""", "matched"))
def insert_summary(spark, d):
    old, new = split(spark, d)
    out = mg.merge_batch(new, st.build_stories(old, CFG), st.story_links(old, CFG), old, CFG)
    return counts.add_summaries(counts.insert_summary(out.results))


@query("reindex", assemble(
    """SELECT story_id, round(score, 6) AS score, 'merged' AS result FROM candidates
       UNION ALL SELECT 'gone', NULL, 'not_found'""", "candidates"))
def reindex(spark, d):
    from linkloom.operators import ranking
    rows = scrapes(spark, d)
    stories = st.build_stories(rows, CFG)
    front = ranking.front_page_candidates(stories, CFG.hot_set_size).select("story_id")
    wanted = front.unionByName(spark.range(1).select(F.lit("gone").alias("story_id")))
    out = mg.reindex(wanted, stories, st.story_links(rows, CFG), rows, CFG)
    return out.results.join(out.changed.select("story_id", r6("score").alias("score")),
                            "story_id", "left").select("story_id", "score", "result")


@query("upsert_scrapes", assemble(
    """SELECT shard, scrape_id, comments FROM (
         SELECT *, row_number() OVER (PARTITION BY shard, scrape_id
                                      ORDER BY late DESC, seq DESC) AS rn
         FROM (SELECT shard, scrape_id, comments, seq, 0 AS late FROM scrapes
               UNION ALL
               SELECT shard, scrape_id, comments + 1000, seq, 1 FROM scrapes
               WHERE source IN ('reddit', 'feed')
               UNION ALL
               SELECT shard, scrape_id, comments + 2000, seq + 1, 1 FROM scrapes
               WHERE source = 'reddit')) WHERE rn = 1""", "scrapes"))
def upsert_scrapes(spark, d):
    rows = scrapes(spark, d)
    _, late = split(spark, d)
    batch = (late.withColumn("comments", F.col("comments") + 1000)
             .unionByName(late.where("source = 'reddit'")
                          .withColumn("comments", F.col("comments") + 2000)
                          .withColumn("seq", F.col("seq") + 1)))
    return upsert.upsert_scrapes(rows, batch).select(
        F.col("shard").cast("bigint").alias("shard"), "scrape_id",
        F.col("comments").cast("bigint").alias("comments"))


cte("all_links", """
    SELECT e.shard, e.story_id, c.shard AS scrape_shard, count(*) OVER (PARTITION BY e.story_id) AS n
    FROM clustered c JOIN evaluated e USING (url_norm, anchor)""", "clustered", "evaluated")


cte("kept_links", "SELECT * FROM all_links WHERE scrape_shard % 11 <> 0", "all_links")
cte("told_stories", "SELECT shard, story_id, max(n) AS n FROM all_links WHERE shard % 7 <> 0 GROUP BY ALL",
    "all_links")
cte("counted_links", "SELECT shard, story_id, count(*) AS k FROM kept_links GROUP BY ALL", "kept_links")


@query("validate", assemble(
    """SELECT shard, count(t.n) + count(t.n) FILTER (shard % 5 = 0) AS stories,
              count(t.n) FILTER (shard % 5 = 0) AS duplicate_ids, 0::BIGINT AS null_keys,
              coalesce(max(d.dangling), 0)::BIGINT AS dangling_links,
              coalesce(sum(k) FILTER (t.n IS NULL), 0)::BIGINT AS orphan_links,
              count(*) FILTER (k IS NULL) AS unlinked_stories, count(*) FILTER (t.n <> k) AS wrong_counts
       FROM told_stories t FULL JOIN counted_links c USING (shard, story_id)
       LEFT JOIN (SELECT shard, count(*) AS dangling FROM kept_links WHERE scrape_shard % 13 = 0 GROUP BY 1) d USING (shard)
       GROUP BY shard""", "told_stories", "counted_links"))
def validate(spark, d):
    """Over tables with faults: months of each table are missing, others are doubled."""
    rows = scrapes(spark, d)
    stories = st.build_stories(rows, CFG).where("shard % 7 <> 0")
    stories = stories.unionByName(stories.where("shard % 5 = 0"))
    links = st.story_links(rows, CFG).where("scrape_shard % 11 <> 0")
    return quality.validate(stories, links, rows.where("shard % 13 <> 0")).withColumn(
        "shard", F.col("shard").cast("bigint"))


@query("bulk_load", assemble(
    """SELECT shard::BIGINT AS shard, count(*) AS stories, sum(n)::BIGINT AS links
       FROM (SELECT shard, story_id, max(n) AS n FROM all_links GROUP BY ALL) GROUP BY shard""", "all_links"))
def bulk_load(spark, d):
    """A store loaded from scrapes of which every third comes twice, the earlier time in
    another month; stories and links must agree."""
    from linkloom.plans.store import StoryStore
    from linkloom.session import shared_path
    rows = scrapes(spark, d)
    early = (rows.where("seq % 3 = 0").withColumn("date", F.col("date") - F.expr("INTERVAL 40 DAYS"))
             .withColumn("shard", (F.year("date") * 12 + F.month("date") - 1).cast("int"))
             .withColumn("seq", F.col("seq") - 1_000_000_000))
    store = StoryStore(spark, shared_path(spark, "bulk-load"), CFG)
    store.load(rows.unionByName(early))
    links = store.links.groupBy("shard", "story_id").agg(F.count(F.lit(1)).alias("k"))
    told = store.stories.join(links, ["shard", "story_id"], "left")
    return told.groupBy(F.col("shard").cast("bigint").alias("shard")).agg(
        F.count(F.lit(1)).alias("stories"), F.sum(F.when(F.col("k") == F.col("n_scrapes"), F.col("k"))).alias("links"))


@query("repeated_urls", assemble(
    """SELECT url_norm, shard, count(*) AS n FROM (
         SELECT url_norm, shard FROM stories
         UNION ALL SELECT url_norm, shard FROM stories WHERE shard % 3 = 0)
       GROUP BY ALL HAVING count(*) > 1""", "stories"))
def repeated_urls(spark, d):
    """Stories, those of some months doubled; without that the result is empty."""
    stories = st.build_stories(scrapes(spark, d), CFG)
    return quality.repeated_urls(stories.unionByName(stories.where("shard % 3 = 0"))).select(
        "url_norm", F.col("shard").cast("bigint").alias("shard"), "n")


@query("fetch_scrape", assemble(
    """SELECT scrape_id, raw_title FROM scrapes
       ORDER BY date DESC, scrape_id LIMIT 1""", "scrapes"))
def fetch_scrape(spark, d):
    rows = scrapes(spark, d)
    key = rows.orderBy(F.desc("date"), "scrape_id").select("shard", "scrape_id").first()
    return joins.fetch_scrape(rows, key.shard, key.scrape_id).select("scrape_id", "raw_title")
