"""Payload parsing, crawl plan, posts, backups, rate limits and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import dates
from linkloom.operators import ranking
from linkloom.session import shared_path, staged
from linkloom.sources import backup, crawl, payloads, posts
from linkloom.sources.derived import sightings, table

from .registry import joined, query, scrapes
from .sqlbase import assemble

# Sightings are bundled, 25 order numbers at a time, into payloads of their site's format
# and then parsed again; the twin computes the expected rows from the tables.
_BUNDLE = 25


def _bundled(spark, d, source):
    rows = sightings(spark, d, raw_text=True).where(F.col("source") == source)
    return rows.withColumn("payload", F.floor(F.col("seq") / _BUNDLE))


def _payloads(bundled, item, before: str, between: str, after: str, source: str):
    texts = bundled.select("payload", F.struct("seq", item.alias("t")).alias("s"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), between)
    return texts.groupBy("payload").agg(F.concat(F.lit(before), body, F.lit(after)).alias("body")) \
        .select("payload", F.lit(source).alias("source"), F.lit("x").alias("url"),
                F.lit(200).alias("status"), "body", F.lit(None).cast("timestamp").alias("fetched_at"))


_MANY = 4_000_000_000  # a counter may be larger than a signed 32-bit number


def reddit_payloads(spark, d, numbered=False):
    rows = _bundled(spark, d, "reddit")
    item = F.to_json(F.struct(F.lit("t3").alias("kind"), F.struct(
        "id", F.initcap("subsource").alias("subreddit"),
        (F.col("seq") % 13 == 0).alias("stickied"),
        F.unix_seconds("date").cast("double").alias("created_utc"), "url",
        (F.lit(5) if numbered else F.col("raw_title")).alias("title"), (F.col("comments") + _MANY).alias("num_comments"), "score",
        F.col("downvotes").alias("downs"),
        F.when(F.col("seq") % 17 == 0, -1).otherwise(F.col("upvotes")).alias("ups"),
        "upvote_ratio", F.col("flair").alias("link_flair_text")).alias("data")))
    return _payloads(rows, item, '{"data":{"children":[', ",", "]}}", "reddit")


@query("parse_reddit", assemble(
    """SELECT payload, id, subsource, url, raw_title, date_s, position, comments, upvotes, flair
       FROM (SELECT seq // 25 AS payload, id, subsource, url, raw_title, seq,
                    epoch(date)::BIGINT AS date_s, comments + 4000000000 AS comments, upvotes, flair,
                    row_number() OVER (PARTITION BY seq // 25, subsource ORDER BY seq) AS position
             FROM scrapes WHERE source = 'reddit' AND seq % 13 <> 0) WHERE seq % 17 <> 0""",
    "scrapes"))
def parse_reddit(spark, d):
    out = payloads.parse_reddit(reddit_payloads(spark, d)).scrapes
    return out.select("payload", "id", "subsource", "url", "raw_title",
                      F.unix_seconds("date").alias("date_s"),
                      *[F.col(c).cast("bigint").alias(c) for c in ("position", "comments", "upvotes")],
                      "flair")


@query("parse_warnings", assemble(
    """SELECT seq // 25 AS payload, CASE WHEN seq % 13 = 0 THEN 'Ignoring stickied story'
              ELSE 'Bad integer ups' END AS message, count(*) AS n
       FROM scrapes WHERE source = 'reddit' AND (seq % 13 = 0 OR seq % 17 = 0) GROUP BY ALL""",
    "scrapes"))
def parse_warnings(spark, d):
    out = payloads.parse_reddit(reddit_payloads(spark, d)).warnings
    return out.groupBy("payload", "message").agg(F.count(F.lit(1)).alias("n"))


@query("parse_types", assemble(
    """SELECT seq // 25 AS payload, CASE WHEN seq % 13 = 0 THEN 'Ignoring stickied story' ELSE 'Missing field title' END AS message,
              count(*) AS n FROM scrapes WHERE source = 'reddit' GROUP BY ALL""", "scrapes"))
def parse_types(spark, d):
    """Titles that are JSON numbers are no titles."""
    out = payloads.parse_reddit(reddit_payloads(spark, d, numbered=True))
    return out.warnings.groupBy("payload", "message").agg(F.count(F.lit(1)).alias("n"))


@query("parse_rss", assemble(
    """SELECT payload, id, url, raw_title, date_s, position, tags FROM (
         SELECT seq // 25 AS payload, id, url, raw_title, epoch(date)::BIGINT AS date_s, seq,
                array_to_string(tags, ',') AS tags,
                row_number() OVER (PARTITION BY seq // 25 ORDER BY seq) AS position
         FROM scrapes WHERE source = 'lobsters') WHERE seq % 19 <> 0""", "scrapes"))
def parse_rss(spark, d):
    return payloads.parse_lobsters(lobsters_payloads(spark, d)).scrapes.select(
        "payload", "id", "url", "raw_title", F.unix_seconds("date").alias("date_s"),
        F.col("position").cast("bigint").alias("position"), joined("tags").alias("tags"))


def lobsters_payloads(spark, d):
    rows = _bundled(spark, d, "lobsters")

    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    item = F.concat(
        F.lit("<item>"), tag("title", F.col("raw_title")),
        tag("link", F.replace("url", F.lit("&"), F.lit("&amp;"))),
        F.lit('<guid isPermaLink="false">https://lobste.rs/s/'), "id", F.lit("</guid>"),
        F.when(F.col("seq") % 19 == 0, F.lit("")).otherwise(
            tag("pubDate", dates.to_rfc2822(F.col("date")))),
        F.array_join(F.transform("tags", lambda t: tag("category", t)), ""), F.lit("</item>"))
    return _payloads(rows, item, '<?xml version="1.0"?><rss><channel>', "",
                     "</channel></rss>", "lobsters")


def _attr(value):
    return F.replace(value, F.lit("&"), F.lit("&amp;"))


@query("parse_hn", assemble(
    """SELECT seq // 25 AS payload, id, url, raw_title, epoch(date)::BIGINT AS date_s, position,
              points, comments FROM scrapes WHERE source = 'hacker_news' AND seq % 23 <> 0""",
    "scrapes"))
def parse_hn(spark, d):
    return payloads.parse_hacker_news(hn_payloads(spark, d)).scrapes.select(
        "payload", "id", "url", "raw_title", F.unix_seconds("date").alias("date_s"),
        *[F.col(c).cast("bigint").alias(c) for c in ("position", "points", "comments")])


def hn_payloads(spark, d):
    rows = _bundled(spark, d, "hacker_news")
    story = F.concat(
        F.lit('<tr class="athing" id="'), "id", F.lit('"><td><span class="rank">'), "position",
        F.lit('.</span></td><td class="votelinks"></td><td class="title"><span class="titleline">'
              '<a href="'), _attr("url"), F.lit('">'), "raw_title",
        F.lit('</a> <span class="sitebit"><a href="from?site=x">x</a></span></span></td></tr>'))
    talk = F.when(F.col("comments") == 0, F.lit("discuss")).otherwise(
        F.concat(F.col("comments").cast("string"), F.lit("&nbsp;comments")))
    info = F.concat(
        F.lit('<tr><td colspan="2"></td><td class="subtext"><span class="score" id="score_'), "id",
        F.lit('">'), "points", F.lit(' points</span> <span class="age" title="'),
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(' 1"><a href="item?id='), "id",
        F.lit('">1 day ago</a></span> | <a href="hide">hide</a> | <a href="item?id='), "id",
        F.lit('">'), talk, F.lit("</a></td></tr>"))
    item = F.concat(story, F.when(F.col("seq") % 23 == 0, F.lit("")).otherwise(info))
    return _payloads(rows, item, "<html><table>", '<tr class="spacer"></tr>', "</table></html>",
                     "hacker_news")


@query("parse_slashdot", assemble(
    """SELECT seq // 25 AS payload, '23/01/' || (seq % 28) || '/' || id AS id, url, raw_title,
              epoch(date)::BIGINT AS date_s,
              CASE WHEN comments % 5 = 0 THEN 0 ELSE comments END AS comments,
              array_to_string(list_transform(tags, lambda t: lower(replace(t, '+', 'p'))), ',') AS tags
       FROM scrapes WHERE source = 'slashdot' AND seq % 29 <> 0""", "scrapes"))
def parse_slashdot(spark, d):
    return payloads.parse_slashdot(slashdot_payloads(spark, d)).scrapes.select(
        "payload", "id", "url", "raw_title", F.unix_seconds("date").alias("date_s"),
        F.col("comments").cast("bigint").alias("comments"), joined("tags").alias("tags"))


def slashdot_payloads(spark, d):
    rows = _bundled(spark, d, "slashdot")
    topics = F.array_join(F.transform("tags", lambda t: F.concat(
        F.lit('<a href="//slashdot.org/index2.pl?fhfilter='),
        F.lower(F.replace(t, F.lit("+"), F.lit("p"))), F.lit('"><img src="x.png"></a>'))), "")
    bubble = F.when(F.col("comments") % 5 == 0, F.lit("")).otherwise(F.concat(
        F.lit('<span class="comment-bubble"><a href="#c">'), F.col("comments").cast("string"),
        F.lit("</a></span>")))
    item = F.concat(
        F.lit('<article class="fhitem article usermode"><header><span class="topic" id="t">'),
        topics, F.lit('</span><h2 class="story"><span class="story-title"><a href="'
                      '//tech.slashdot.org/story/23/01/'),
        (F.col("seq") % 28).cast("string"), F.lit("/"), "id", F.lit('/some-title">'), "raw_title",
        F.lit("</a>"), F.when(F.col("seq") % 29 == 0, F.lit("")).otherwise(F.concat(
            F.lit(' <span class="no extlnk"><a class="story-sourcelnk" href="'), _attr("url"),
            F.lit('">(site)</a></span>'))),
        F.lit("</span>"), bubble, F.lit("</h2></header><time>"),
        F.date_format(F.from_utc_timestamp("date", "US/Eastern"),
                      "'on 'EEEE MMMM dd, yyyy' @'hh:mma"), F.lit("</time></article>"))
    return _payloads(rows, item, "<html><body>", "\n", "</body></html>", "slashdot")


_LOST = "seq % CASE source WHEN 'reddit' THEN 17 WHEN 'lobsters' THEN 19 WHEN 'hacker_news' THEN 23 ELSE 29 END = 0"


@query("scrape_payloads", assemble(
    f"""SELECT 'scrape' AS part, source, count(*) AS n FROM scrapes
        WHERE source <> 'feed' AND (seq // 25) % 4 <> 0 AND NOT {_LOST}
          AND NOT (source = 'reddit' AND seq % 13 = 0) GROUP BY source
        UNION ALL
        SELECT 'HTTP', source, count(DISTINCT seq // 25) FROM scrapes
        WHERE source <> 'feed' AND (seq // 25) % 4 = 0 GROUP BY source
        UNION ALL
        SELECT 'No parser', 'elsewhere', count(DISTINCT seq // 25) FROM scrapes WHERE source = 'reddit'""",
    "scrapes"))
def scrape_payloads(spark, d):
    """All four sites, every fourth fetch failed, and one source nobody parses."""
    rows = None
    for bundle in (reddit_payloads, lobsters_payloads, hn_payloads, slashdot_payloads):
        part = bundle(spark, d).withColumn("status", F.when(F.col("payload") % 4 == 0, 503).otherwise(200))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.unionByName(reddit_payloads(spark, d).withColumn("source", F.lit("elsewhere")))
    parsed = payloads.scrape_payloads(rows)
    part = F.when(F.col("accepted"), "scrape").otherwise(F.regexp_extract("message", "^(HTTP|No parser)", 1))
    return (parsed.rows.select(part.alias("part"), "source").where("part <> ''")
            .groupBy("part", "source").agg(F.count(F.lit(1)).alias("n")))


@query("crawl_plan", assemble(
    """SELECT 'reddit' AS source, 'https://reddit.com/r/' || string_agg(name, '+' ORDER BY name)
              || '/.json?limit=50' AS url
       FROM (SELECT name, (row_number() OVER (ORDER BY name) - 1) // 5 AS batch
             FROM (SELECT DISTINCT subsource AS name FROM scrapes WHERE subsource IS NOT NULL))
       GROUP BY batch
       UNION ALL SELECT unnest(['hacker_news', 'hacker_news', 'slashdot', 'lobsters']),
         unnest(['https://news.ycombinator.com/news', 'https://news.ycombinator.com/news?p=2',
                 'https://slashdot.org/', 'https://lobste.rs/rss'])""", "scrapes"))
def crawl_plan(spark, d):
    names = (scrapes(spark, d).where("subsource IS NOT NULL")
             .select("source", F.col("subsource").alias("name")).distinct())
    return crawl.crawl_plan(names)


@query("posts", r"""
    SELECT id, title, 'https://example.org/blog/' || id || '/' || slug AS url, date_s, tags,
           'feed-' || date_s AS scrape_id
    FROM (SELECT id, title, regexp_replace(replace(lower(title), ' ', '-'),
                   '[^\p{L}\p{N}_-]', '', 'g') AS slug,
                 epoch(CAST(id AS TIMESTAMP))::BIGINT AS date_s, lang || ',' || source || ',blog' AS tags
          FROM (SELECT strftime(DATE '2000-01-01' + CAST(doc_id AS INTEGER), '%Y-%m-%d') AS id,
                       'No ' || doc_id || ': ' || source || '!' AS title, lang, source
                FROM documents))""")
def post_rows(spark, d):
    found = post_table(spark, d)
    sids = posts.as_scrapes(found).select("url", "scrape_id")
    return found.join(sids, "url").select(
        "id", "title", "url", F.unix_seconds("date").alias("date_s"), joined("tags").alias("tags"),
        "scrape_id")


def post_table(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(
        F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("doc_id").cast("int")),
                      "yyyy-MM-dd").alias("name"),
        F.concat(F.lit("---\ntags: "), "lang", F.lit(", "), "source", F.lit("\ntitle: No "),
                 F.col("doc_id").cast("string"), F.lit(": "), "source", F.lit("!\n---\n"), "text")
        .alias("contents"))
    return posts.posts(files, "example.org")


@query("live_pin", r"""
    SELECT 'two days' AS after, 'https://example.org/blog/' || id || '/' || regexp_replace(
             replace(lower('No ' || doc_id || ': ' || source || '!'), ' ', '-'), '[^\p{L}\p{N}_-]', '', 'g') AS url
    FROM (SELECT doc_id, source, strftime(DATE '2000-01-01' + CAST(doc_id AS INTEGER), '%Y-%m-%d') AS id FROM documents)
    ORDER BY id DESC LIMIT 1""")
def live_pin(spark, d):
    """The newest post is pinned a day after it, and no longer after three."""
    found = post_table(spark, d)
    newest = found.agg(F.max("date")).scalar()
    out = None
    for name, hours in (("two days", 47), ("three days", 72)):
        part = ranking.live_pin(found, newest + F.make_dt_interval(F.lit(0), F.lit(hours))).select(F.lit(name).alias("after"), "url")
        out = part if out is None else out.unionByName(part)
    return out


@query("backup_changed", assemble(
    """SELECT m.shard::BIGINT AS shard, coalesce(n, 0) AS count,
              CASE WHEN n IS NULL THEN 'empty' WHEN late OR renamed THEN 'success' ELSE 'no_change' END AS result
       FROM (SELECT unnest(range(min(shard), max(shard) + 1)) AS shard FROM scrapes WHERE shard % 11 <> 5) m
       LEFT JOIN (SELECT shard, count(*) AS n, bool_or(source = 'feed' AND year(date) IN (1996, 1999)) AS late,
                         bool_or(source = 'lobsters' AND shard % 7 = 3) AS renamed
                  FROM scrapes WHERE shard % 11 <> 5 GROUP BY shard) USING (shard)""", "scrapes"))
def backup_changed(spark, d):
    """Two backups. Before the second, feed scrapes of two years arrive and titles of some
    months change, with no date and no number of rows changed; some months have no rows."""
    rows = scrapes(spark, d).drop("seq").where("shard % 11 <> 5")
    renamed = (F.col("source") == "lobsters") & (F.col("shard") % 7 == 3)
    before = (rows.where(~((F.col("source") == "feed") & F.year("date").isin(1996, 1999)))
              .withColumn("raw_title", F.when(renamed, F.lit("old")).otherwise(F.col("raw_title"))))
    path = shared_path(spark, "backup")
    first = staged(backup.backup(before, None, path).where("result = 'success'").drop("result"), "manifest")
    return backup.backup(rows, first, path).select(F.col("shard").cast("bigint").alias("shard"), "count", "result")


@query("import_backup", assemble(
    """SELECT scrape_id, source, subsource, id, url, raw_title, epoch(date)::BIGINT AS date_s,
              position, points, comments, score, upvotes, flair,
              array_to_string(tags, ',') AS tags FROM scrapes""", "scrapes"))
def import_backup(spark, d):
    """From files, written a month at a time."""
    path = shared_path(spark, "backup")
    backup.backup(scrapes(spark, d), None, path)
    return backup.read_backup(spark, path).select(
        "scrape_id", "source", "subsource", "id", "url", "raw_title",
        F.unix_seconds("date").alias("date_s"),
        *[F.col(c).cast("bigint").alias(c)
          for c in ("position", "points", "comments", "score", "upvotes")],
        "flair", joined("tags").alias("tags"))
