"""Counts, statistics, trends, tags and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import counts, ranking, search
from linkloom.plans import front_page as fp
from linkloom.plans import stories as st
from linkloom.session import staged

from .registry import CFG, query, r6, scrapes
from .sqlbase import assemble, cte, month_label
from .stories import SHOWN, staged_stories, stories_of


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


@query("counts_by_month", assemble(
    """SELECT shard, story_count::BIGINT AS story_count, scrape_count::BIGINT AS scrape_count FROM (
         SELECT m.shard, coalesce(s.n, 0) AS story_count, coalesce(c.n, 0) AS scrape_count
         FROM (SELECT unnest(range(min(shard), max(shard) + 1)) AS shard FROM scrapes) m
         LEFT JOIN (SELECT shard, count(*) n FROM stories GROUP BY 1) s USING (shard)
         LEFT JOIN (SELECT shard, count(*) n FROM scrapes GROUP BY 1) c USING (shard)
         UNION ALL SELECT NULL, (SELECT count(*) FROM stories), (SELECT count(*) FROM scrapes))""",
    "stories"))
def counts_by_month(spark, d):
    rows = scrapes(spark, d)
    out = counts.counts_by_month(st.build_stories(rows, CFG), rows)
    return out.select(*big("shard", "story_count", "scrape_count"))


@query("store_stats", assemble(
    """SELECT shard, count(*) AS count, epoch(min(date))::BIGINT AS earliest,
              epoch(max(date))::BIGINT AS latest FROM scrapes GROUP BY shard""", "scrapes"))
def store_stats(spark, d):
    return counts.store_stats(scrapes(spark, d)).select(
        *big("shard", "count", "earliest", "latest"))


@query("newest", assemble(
    "SELECT epoch(max(date))::BIGINT AS now_s FROM stories", "stories"))
def newest(spark, d):
    return counts.newest(stories_of(spark, d)).select(F.unix_seconds("now").alias("now_s"))


@query("month_sequence", assemble(
    f"""SELECT shard, {month_label('shard')} AS label FROM (
          SELECT unnest(range(min(shard), max(shard) + 1)) AS shard FROM scrapes)""", "scrapes"))
def month_sequence(spark, d):
    from linkloom.functions.months import month_label as label
    return counts.month_range(scrapes(spark, d).select("shard")).select(
        *big("shard"), label(F.col("shard")).alias("label"))


cte("tag_hits", r"""
    SELECT * FROM stories WHERE list_contains(tags, 'ringtag')
       OR regexp_matches(lower(title), '(^|[^\p{L}\p{N}])(ringtag|ring)([^\p{L}\p{N}]|$)')""",
    "stories")


@query("hits_by_month", assemble(
    """SELECT m.shard, coalesce(h.n, 0) AS hits
       FROM (SELECT unnest(range(min(shard), max(shard) + 1)) AS shard FROM stories) m
       LEFT JOIN (SELECT shard, count(*) n FROM tag_hits GROUP BY 1) h USING (shard)""",
    "tag_hits"))
def hits_by_month(spark, d):
    stories = stories_of(spark, d)
    hits = search.matches(stories, "tag", "ringtag", "ring")
    out = counts.hits_by_month(hits, counts.month_range(stories.select("shard")))
    return out.select(*big("shard", "hits"))


@query("capped_count", assemble(
    "SELECT least(100, count(*)) AS n FROM tag_hits", "tag_hits"))
def capped_count(spark, d):
    return counts.capped_count(search.matches(stories_of(spark, d), "tag", "ringtag", "ring"), 100)


cte("trend_raw", """
    SELECT m.shard, CASE WHEN coalesce(t.n, 0) = 0 OR h.n IS NULL THEN 0.0::DOUBLE
                         ELSE h.n / t.n END AS raw,
           row_number() OVER (ORDER BY m.shard) - 1 AS i, count(*) OVER () AS months
    FROM (SELECT unnest(range(min(shard), max(shard) + 1)) AS shard FROM stories) m
    LEFT JOIN (SELECT shard, count(*) n FROM stories GROUP BY 1) t USING (shard)
    LEFT JOIN (SELECT shard, count(*) n FROM tag_hits
               GROUP BY 1) h USING (shard)""", "tag_hits")
cte("trend_kept", """
    SELECT a.shard, a.raw, CASE WHEN a.raw = 0 THEN 1e-12 ELSE a.raw END AS v
    FROM trend_raw a
    WHERE a.i >= least(greatest(a.months - 12, 0),
      (SELECT coalesce(min(b.i), max(x.months)) FROM trend_raw x LEFT JOIN
         (SELECT b.i FROM trend_raw b WHERE EXISTS (
            SELECT 1 FROM trend_raw c WHERE c.i BETWEEN b.i AND b.i + 2 AND c.raw <> 0)
            OR b.i + 2 >= b.months) b ON TRUE))""", "trend_raw")


@query("trend", assemble(
    f"""SELECT {month_label('shard')} AS label, round(raw, 6) AS ratio,
              round(coalesce(lag(v) OVER w, v) * 0.2 + v * 0.6 + coalesce(lead(v) OVER w, v) * 0.2,
                    6) AS smooth FROM trend_kept WINDOW w AS (ORDER BY shard)""", "trend_kept"))
def trend(spark, d):
    stories = stories_of(spark, d)
    hits = search.matches(stories, "tag", "ringtag", "ring")
    return counts.trend(hits, stories).select(
        "label", r6("ratio").alias("ratio"), r6("smooth").alias("smooth"))


@query("top_tags", assemble(
    f"""SELECT {SHOWN} AS tag, n FROM (
          SELECT t, count(*) AS n FROM (
            SELECT unnest(list_concat([host], tags)) AS t FROM hot) GROUP BY t
          HAVING count(*) > 1 ORDER BY n DESC, t LIMIT 50)""", "hot"))
def top_tags(spark, d):
    return ranking.top_tags(fp.front_page(stories_of(spark, d), CFG), CFG.tags)


cte("best_ids", """
    SELECT b.url_norm, b.anchor, b.source, b.scrape_id, b.subsource, e.story_id
    FROM best b JOIN evaluated e USING (url_norm, anchor)""", "best", "evaluated")


@query("source_pivot", assemble(
    """SELECT story_id, max(CASE WHEN source = 'hacker_news' THEN scrape_id END) AS hacker_news,
              max(CASE WHEN source = 'slashdot' THEN scrape_id END) AS slashdot,
              max(CASE WHEN source = 'lobsters' THEN scrape_id END) AS lobsters,
              max(CASE WHEN source = 'reddit' THEN scrape_id END) AS reddit,
              max(CASE WHEN source = 'feed' THEN scrape_id END) AS feed
       FROM best_ids GROUP BY story_id""", "best_ids"))
def source_pivot(spark, d):
    sources = ("hacker_news", "slashdot", "lobsters", "reddit", "feed")
    return stories_of(spark, d).select(
        "story_id", *[F.try_element_at("sources", F.lit(s)).alias(s) for s in sources])


@query("source_counts", assemble(
    """SELECT source, subsource, count(*) AS n FROM best_ids b
       WHERE b.story_id IN (SELECT story_id FROM hot) GROUP BY ALL""", "best_ids", "hot"))
def source_counts(spark, d):
    return counts.source_counts(fp.front_page(stories_of(spark, d), CFG))


@query("metrics", assemble(
    f"""SELECT 'stories_by_shard' AS metric, {month_label('shard')} AS label, count(*) AS value
        FROM stories GROUP BY shard
        UNION ALL SELECT 'stories_by_tag', {SHOWN}, n FROM (
          SELECT t, count(*) AS n FROM (SELECT unnest(list_concat([host], tags)) AS t FROM hot)
          GROUP BY t HAVING count(*) > 1 ORDER BY n DESC, t LIMIT 50)
        UNION ALL SELECT 'stories_by_source', source || coalesce(':' || subsource, ''), count(*)
        FROM best_ids WHERE story_id IN (SELECT story_id FROM hot) GROUP BY source, subsource""",
    "best_ids", "hot"))
def metrics(spark, d):
    stories = staged_stories(spark, d)
    hot = staged(fp.front_page(stories, CFG), "hot")
    return counts.metrics(stories, hot, ranking.top_tags(hot, CFG.tags))


@query("load_years", assemble(
    """SELECT year(date)::BIGINT AS year, count(*) AS n FROM scrapes
       WHERE year(date) IN (1996, 1999) GROUP BY 1""", "scrapes"))
def load_years(spark, d):
    from linkloom.sources.stored import only_years
    rows = only_years(scrapes(spark, d), [1996, 1999])
    return (rows.groupBy(F.year("date").cast("bigint").alias("year"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("scan_month", assemble(
    """SELECT 'scrape' AS kind, scrape_id AS id, epoch(date)::BIGINT AS date_s,
              row_number() OVER (ORDER BY date, scrape_id) - 1 AS place FROM scrapes
       WHERE shard = (SELECT max(shard) FROM scrapes)
       UNION ALL SELECT 'story', story_id, epoch(date)::BIGINT, row_number() OVER (ORDER BY date, story_id) - 1 FROM stories
       WHERE shard = (SELECT max(shard) FROM scrapes)""", "scrapes", "stories"))
def scan_month(spark, d):
    """The newest month of scrapes, and of stories, with the place of each row."""
    from linkloom.sources import stored
    rows, stories = scrapes(spark, d), stories_of(spark, d)
    month = rows.agg(F.max("shard")).first()[0]
    parts = [stored.scan_month(rows, month).rows.select(F.lit("scrape").alias("kind"), F.col("scrape_id").alias("id"), "date", "place"),
             stored.scan_month(stories, month, "story_id").rows.select(F.lit("story").alias("kind"), F.col("story_id").alias("id"), "date", "place")]
    return parts[0].unionByName(parts[1]).select("kind", "id", F.unix_seconds("date").alias("date_s"), "place")


@query("scan_range", assemble(
    """SELECT story_id, shard::BIGINT AS shard, row_number() OVER (ORDER BY shard, date, story_id) - 1 AS place
       FROM stories""", "stories"))
def scan_range(spark, d):
    """All stories, month after month."""
    from linkloom.sources import stored
    return stored.scan_range(stories_of(spark, d)).rows.select("story_id", *big("shard"), "place")


@query("scan_errors", assemble(
    """SELECT message, count(*) AS n FROM (
         SELECT CASE seq % 5 WHEN 0 THEN 'missing date' WHEN 1 THEN 'bad id' WHEN 2 THEN 'missing url'
                             WHEN 3 THEN 'wrong month' ELSE 'read' END AS message FROM scrapes) GROUP BY 1""", "scrapes"))
def scan_errors(spark, d):
    """Rows with a fault each, but every fifth; the scan reports them and reads the rest."""
    from linkloom.sources import stored
    turn = F.col("seq") % 5
    rows = scrapes(spark, d).withColumns({
        "date": F.when(turn != 0, F.col("date")), "url": F.when(turn != 2, F.col("url")),
        "scrape_id": F.when(turn == 1, F.lit("?")).otherwise(F.col("scrape_id")),
        "shard": F.when(turn == 3, F.col("shard") + 1).otherwise(F.col("shard"))})
    scan = stored.scan_range(rows, key="scrape_id")
    return (scan.errors.select("message").unionByName(scan.rows.select(F.lit("read").alias("message")))
            .groupBy("message").agg(F.count(F.lit(1)).alias("n")))
