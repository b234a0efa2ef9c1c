"""Feeds, documents, rate limits and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.config import RateLimit
from linkloom.functions.text import looks_like_bot
from linkloom.operators import ranking, rates
from linkloom.plans import feeds, front_page as fp
from linkloom.sources.derived import table

from .registry import CFG, joined, query
from .sqlbase import assemble, cte
from .stories import SHOWN, stories_of

cte("keyed", """
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY key ORDER BY date DESC, story_id) - 1 AS rank
      FROM (SELECT *, unnest(list_distinct(list_concat([host], tags))) AS key FROM stories))
    WHERE rank < 150""", "stories")
cte("best_links", """
    SELECT b.source, b.scrape_id, e.story_id
    FROM best b JOIN evaluated e USING (url_norm, anchor)""",
    "best", "evaluated")
_SHOWN_TAGS = f"list_concat([host], list_transform(tags, lambda t: {SHOWN}))"


@query("feed_json", assemble(
    f"""SELECT k.key, k.rank, epoch(k.date)::BIGINT AS date_s, k.url, k.title,
               array_to_string({_SHOWN_TAGS}, ',') AS tags,
               max(CASE WHEN b.source = 'hacker_news' THEN b.scrape_id END) AS hacker_news,
               max(CASE WHEN b.source = 'reddit' THEN b.scrape_id END) AS reddit,
               max(CASE WHEN b.source = 'lobsters' THEN b.scrape_id END) AS lobsters,
               max(CASE WHEN b.source = 'slashdot' THEN b.scrape_id END) AS slashdot
        FROM keyed k JOIN best_links b USING (story_id)
        GROUP BY k.key, k.rank, k.date, k.url, k.title, k.host, k.tags""", "keyed", "best_links"))
def feed_json(spark, d):
    stories = stories_of(spark, d)
    ranked = feeds.per_key(stories, feeds.JSON_COUNT, feeds.newest_order())
    back = feeds.read_json_feeds(feeds.json_feeds(ranked, None, CFG))
    return back.select(
        "key", F.col("rank").cast("bigint").alias("rank"), F.unix_seconds("date").alias("date_s"),
        "url", "title", joined("tags").alias("tags"), "hacker_news", "reddit", "lobsters",
        "slashdot")


_AGE = "(epoch((SELECT max(date) FROM stories))::BIGINT - epoch(date)::BIGINT)"
_RELATIVE = f"""CASE WHEN {_AGE} > 750 * 86400 THEN ({_AGE} // (365 * 86400)) || ' years ago'
    WHEN {_AGE} > 60 * 86400 THEN ({_AGE} // (30 * 86400)) || ' months ago'
    WHEN {_AGE} > 2 * 86400 THEN ({_AGE} // 86400) || ' days ago'
    WHEN {_AGE} > 7200 THEN ({_AGE} // 3600) || ' hours ago'
    WHEN {_AGE} > 3600 THEN 'an hour ago' ELSE 'recently added' END"""


@query("feed_text", assemble(
    f"""SELECT key, string_agg('id: story-' || rank || chr(10) || 'date: ' || {_RELATIVE} || chr(10)
              || 'title: ' || title || chr(10) || 'url: ' || url || chr(10) || 'domain: ' || host
              || chr(10) || 'tags:' || array_to_string(list_transform(list_filter({_SHOWN_TAGS},
                 lambda t: NOT contains(t, '.')), lambda t: ' ' || t), ''),
              chr(10) || chr(10) ORDER BY rank) AS value
        FROM keyed WHERE rank < 100 GROUP BY key""", "keyed"))
def feed_text(spark, d):
    stories = stories_of(spark, d)
    ranked = feeds.per_key(stories, feeds.TEXT_COUNT, feeds.newest_order())
    return feeds.text_feeds(ranked, stories.agg(F.max("date")).scalar(), CFG)


def _esc(t: str) -> str:
    return (f"replace(replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>',"
            f" '&gt;'), '\"', '&quot;'), '''', '&#x27;')")


@query("feed_atom", assemble(
    f"""SELECT k.key, k.rank, {_esc('k.title')} AS title, {_esc('k.url')} AS link,
               strftime(k.date, '%Y-%m-%dT%H:%M:%S+00:00') AS updated
        FROM keyed k WHERE k.rank < 30""", "keyed"))
def feed_atom(spark, d):
    stories = stories_of(spark, d)
    ranked = feeds.per_key(stories, feeds.ATOM_COUNT, feeds.newest_order())
    out = feeds.atom_feeds(ranked, stories.agg(F.max("date")).scalar(), "https://example.org",
                           "stories", CFG)
    entries = F.split("value", "<entry>")
    rows = out.select("key", F.posexplode(entries).alias("pos", "e")).where("pos > 0")
    return rows.select(
        "key", (F.col("pos") - 1).cast("bigint").alias("rank"),
        F.regexp_extract("e", "<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("e", "<id>(.*?)</id>", 1).alias("link"),
        F.regexp_extract("e", "<updated>(.*?)</updated>", 1).alias("updated"))


@query("story_documents", assemble(
    """SELECT story_id, title, url_norm, shard, len(tags) AS n_tags FROM stories""", "stories"))
def story_documents(spark, d):
    docs = feeds.story_document(stories_of(spark, d))
    parsed = F.from_json("value", "STRUCT<title: STRING, url_norm: STRING, shard: BIGINT, "
                                  "tags: ARRAY<STRING>>")
    return docs.select("story_id", parsed.alias("p")).select(
        "story_id", "p.title", "p.url_norm", "p.shard",
        F.size("p.tags").cast("bigint").alias("n_tags"))


# One host plays the site itself; the English pages are its known posts.
_OWN = "spam-farm.example.org"


@query("own_posts", assemble(
    f"""SELECT story_id, array_to_string(list_sort(list_distinct(CASE WHEN host = '{_OWN}'
                THEN list_concat(tags, ['post', page]) ELSE tags END)), ',') AS tags
        FROM stories LEFT JOIN (SELECT url, 'page' || min(page_id) AS page FROM pages
          WHERE contains(url, '/en/') GROUP BY url) p USING (url)
        WHERE host <> '{_OWN}' OR page IS NOT NULL""", "stories"))
def own_posts(spark, d):
    known = (table(spark, d, "pages").where(F.col("url").contains("/en/")).groupBy("url")
             .agg(F.min("page_id").alias("_p"), F.first("html").alias("html"))
             .select("url", "html", F.array(F.lit("post"), F.concat(F.lit("page"), "_p")).alias("tags")))
    kept = ranking.with_posts(stories_of(spark, d), known, _OWN)
    return kept.select("story_id", joined(F.sort_array("tags")).alias("tags"))


# Day and ten-day buckets: the events spread 66 per user over 30 days.
_LIMIT = RateLimit(short_seconds=86400, long_seconds=864000, short_soft=1, long_soft=8)
cte("day_counts", """
    SELECT user_id AS key, epoch(ts)::BIGINT // 864000 AS lb, epoch(ts)::BIGINT // 86400 AS sb,
           count(*) AS n, row_number() OVER (PARTITION BY user_id
             ORDER BY epoch(ts)::BIGINT // 86400) AS i FROM events GROUP BY 1, 2, 3""")
cte("chain_rec", """
    SELECT key, i, lb, sb, n, 0::BIGINT AS sp, least(n, 4) AS st, 0::BIGINT AS lp,
           0::BIGINT AS lseen, least(least(n, 4), 32) AS lnow FROM day_counts WHERE i = 1
    UNION ALL
    SELECT key, i, lb, sb, n, sp, st, lp, lseen,
           lseen + least(st, greatest(0, 32 - lp - lseen)) AS lnow
    FROM (SELECT d.key, d.i, d.lb, d.sb, d.n,
            CASE WHEN d.sb = c.sb + 1 THEN c.st ELSE 0 END AS sp,
            least(d.n, greatest(0, 4 - CASE WHEN d.sb = c.sb + 1 THEN c.st ELSE 0 END)) AS st,
            CASE WHEN d.lb = c.lb THEN c.lp WHEN d.lb = c.lb + 1 THEN c.lnow ELSE 0 END AS lp,
            CASE WHEN d.lb = c.lb THEN c.lnow ELSE 0 END AS lseen
          FROM chain_rec c JOIN day_counts d ON d.key = c.key AND d.i = c.i + 1)""", "day_counts")


@query("rate_limits", assemble(
    """SELECT CAST(key AS VARCHAR) AS key, sb * 86400 AS bucket_start, calm AS none,
              passed - calm AS soft, n - passed AS hard
       FROM (SELECT *, least(st, greatest(0, 32 - lp - lseen)) AS passed,
                    greatest(0, least(least(2 - sp, 16 - lp - lseen),
                      least(st, greatest(0, 32 - lp - lseen)))) AS calm FROM chain_rec)""",
    "chain_rec"))
def rate_limits(spark, d):
    events = table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return rates.rate_summary(events, _LIMIT)


@query("rate_levels", assemble(
    """SELECT e.event_id, CASE WHEN r >= st OR r >= greatest(0, 32 - lp - lseen) THEN 'hard'
              WHEN sp + r >= 2 OR lp + lseen + r >= 16 THEN 'soft' ELSE 'none' END AS level
       FROM (SELECT event_id, user_id AS key, epoch(ts)::BIGINT // 86400 AS sb,
                    row_number() OVER (PARTITION BY user_id, epoch(ts)::BIGINT // 86400
                                       ORDER BY ts, event_id) - 1 AS r FROM events) e
       JOIN chain_rec USING (key, sb)""", "chain_rec"))
def rate_levels(spark, d):
    events = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return rates.classify_events(events, _LIMIT).select("event_id", "level")


@query("bot_agents", """
    SELECT event_type || ' ' || props AS agent, count(*) AS n,
           regexp_matches(lower(event_type || ' ' || props), 'bot|http:|https:|python|curl') AS bot
    FROM events GROUP BY 1""")
def bot_agents(spark, d):
    agent = F.concat_ws(" ", "event_type", "props")
    return (table(spark, d, "events").select(agent.alias("agent")).groupBy("agent")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bot", looks_like_bot(F.col("agent"))))


def _walk(name: str, events: str, limit: RateLimit) -> None:
    """CTE ``name`` (key, event_id, level): events (key, s, event_id, i) walked one by one."""
    def side(letter: str, seconds: int) -> str:
        b = f"e.s // {seconds}"
        return (f"{b} AS {letter}b, CASE WHEN {b} = w.{letter}b THEN w.{letter}p WHEN {b} = w.{letter}b + 1 THEN w.{letter}n ELSE 0 END AS {letter}p,"
                f" CASE WHEN {b} = w.{letter}b THEN w.{letter}n ELSE 0 END AS {letter}n")
    ok_s, ok_l = f"sp + sn < {2 * limit.short_hard}", f"lp + ln < {2 * limit.long_hard}"
    cte(f"{name}_rec", f"""
        SELECT DISTINCT key, 0::BIGINT AS i, NULL::BIGINT AS event_id, '' AS level, -2::BIGINT AS sb, 0::BIGINT AS sp,
               0::BIGINT AS sn, -2::BIGINT AS lb, 0::BIGINT AS lp, 0::BIGINT AS ln FROM {events}
        UNION ALL
        SELECT key, i, event_id,
               CASE WHEN NOT ({ok_s}) OR NOT ({ok_l}) THEN 'hard'
                    WHEN sp + sn >= {2 * limit.short_soft} OR lp + ln >= {2 * limit.long_soft} THEN 'soft' ELSE 'none' END,
               sb, sp, sn + ({ok_s})::BIGINT, lb, lp, ln + ({ok_s} AND {ok_l})::BIGINT
        FROM (SELECT e.key, e.i, e.event_id, {side('s', limit.short_seconds)}, {side('l', limit.long_seconds)}
              FROM {name}_rec w JOIN {events} e ON e.key = w.key AND e.i = w.i + 1)""", events)


_BOT_LIMIT = RateLimit(short_seconds=3600, long_seconds=86400, short_soft=1, long_soft=10)
cte("ip_events", """
    SELECT user_id::VARCHAR AS key, floor(epoch(ts))::BIGINT AS s, event_id::BIGINT AS event_id, event_type AS agent,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events""")
_walk("ip", "ip_events", _LIMIT)
# Only bots that the first limit lets pass are counted by the second.
cte("bot_events", """
    SELECT agent AS key, s, event_id, row_number() OVER (PARTITION BY agent ORDER BY ts, event_id) AS i
    FROM ip_rec JOIN (SELECT event_id, ts, event_type AS agent, floor(epoch(ts))::BIGINT AS s FROM events) USING (event_id)
    WHERE level <> 'hard' AND agent = 'error'""", "ip_rec")
_walk("bot", "bot_events", _BOT_LIMIT)


@query("request_levels", assemble(
    """SELECT p.event_id, CASE WHEN p.level = 'hard' OR b.level = 'hard' THEN 'hard'
              WHEN p.level = 'soft' OR b.level = 'soft' THEN 'soft' ELSE 'none' END AS level
       FROM ip_rec p LEFT JOIN bot_rec b USING (event_id) WHERE p.event_id IS NOT NULL""", "ip_rec", "bot_rec"))
def request_levels(spark, d):
    """Requests through the ip limits and, for bots, the agent limits."""
    requests = table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("ip"),
        F.col("event_type").alias("agent"), (F.col("event_type") == "error").alias("is_bot"),
        F.col("ts").cast("timestamp").alias("ts"))
    out = rates.classify_requests(requests, _LIMIT, _BOT_LIMIT)
    return out.select(F.col("event_id").cast("bigint").alias("event_id"), "level")


@query("event_windows", """
    SELECT epoch(time_bucket(INTERVAL 60 MINUTE, ts))::BIGINT AS start_s, event_type AS path,
           count(*) AS n FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    events = table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"))
    return rates.page_windows(events).select(
        F.unix_seconds("window_start").alias("start_s"), "path", "n")
