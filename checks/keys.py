"""Keys, dates, text and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import dates, ids, months, text, urls
from linkloom.operators import search
from linkloom.sources.derived import table

from .registry import CFG, joined, query, scrapes
from .sqlbase import assemble, cte, host, month_label, norm, story_id, unescape


@query("url_keys", f"SELECT page_id, url, {host('url')} AS host, {norm('url')} AS url_norm FROM pages")
def url_keys(spark, d):
    return urls.with_url_keys(table(spark, d, "pages").select("page_id", "url")).select(
        "page_id", "url", "host", "url_norm")


@query("host_tokens", f"""
    SELECT token, count(*) AS n FROM (
      SELECT unnest(list_filter(regexp_split_to_array({host('url')}, '[^a-z0-9]+'),
                                lambda t: t <> '')) AS token FROM pages) GROUP BY token""")
def host_tokens(spark, d):
    pages = table(spark, d, "pages")
    return (pages.select(F.explode(urls.host_tokens(urls.host(F.col("url")))).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))


@query("url_jitter", f"""
    SELECT page_id, round(((('0x' || substr(md5({norm('url')}), 1, 13))::BIGINT) % 6000000)
                          / 1000000.0::DOUBLE, 6) AS jitter FROM pages""")
def url_jitter(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.round(urls.jitter(urls.url_norm(F.col("url"))), 6).alias("jitter"))


@query("story_ids", assemble(
    f"""SELECT scrape_id, {story_id('date', 'url_norm')} AS story_id, url_norm AS norm,
               year(date) * 12 + month(date) - 1 AS shard, TRUE AS same_day FROM core""", "core"))
def story_ids(spark, d):
    rows = urls.with_url_keys(scrapes(spark, d))
    rows = rows.withColumn("story_id", ids.story_id(F.col("date"), F.col("url_norm")))
    back = ids.decode_story_id(F.col("story_id"))
    return rows.select(
        "scrape_id", "story_id", back["norm"].alias("norm"),
        back["shard"].cast("bigint").alias("shard"),
        ids.story_id_matches_date(F.col("story_id"), F.col("date")).alias("same_day"))


@query("month_keys", f"""
    SELECT o_orderkey AS k, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS shard,
           strftime(o_orderdate, '%Y-%m') AS label,
           year(o_orderdate) * 12 + month(o_orderdate) - 1 + 11 AS later,
           {month_label("year(o_orderdate) * 12 + month(o_orderdate) - 1 - 11")} AS earlier_label,
           epoch(date_trunc('month', o_orderdate))::BIGINT AS start_s FROM orders""")
def month_keys(spark, d):
    shard = months.month_of(F.col("o_orderdate"))
    label = months.month_label(shard)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"),
        months.month_from_label(label).cast("bigint").alias("shard"), label.alias("label"),
        months.plus_months(shard, 11).cast("bigint").alias("later"),
        months.month_label(months.plus_months(shard, -11)).alias("earlier_label"),
        F.unix_seconds(months.month_start(shard)).alias("start_s"))


_COMMENTS = """CASE source
    WHEN 'hacker_news' THEN 'https://news.ycombinator.com/item?id=' || id
    WHEN 'slashdot' THEN 'https://tech.slashdot.org/story/' || id || '/'
    WHEN 'lobsters' THEN 'https://lobste.rs/s/' || id || '/'
    WHEN 'reddit' THEN 'https://www.reddit.com/r/' || subsource || '/comments/' || id || '/'
    ELSE '' END"""


@query("comment_urls", assemble(
    f"""SELECT scrape_id, {_COMMENTS} AS comments_url,
               CASE WHEN source <> 'feed' THEN id END AS back_id,
               CASE WHEN source = 'reddit' THEN subsource END AS back_sub,
               source AS parsed_source FROM scrapes""", "scrapes"))
def comment_urls(spark, d):
    link = ids.comments_url_of_id(F.col("scrape_id"))
    back = ids.id_from_comments_url(F.col("source"), F.col("comments_url"))
    return (scrapes(spark, d).withColumn("comments_url", link).select(
        "scrape_id", "comments_url", back["id"].alias("back_id"),
        back["subsource"].alias("back_sub"),
        ids.parse_scrape_id(F.col("scrape_id"))["source"].alias("parsed_source")))


@query("unescaped_titles", f"""
    SELECT page_id, {unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title
    FROM pages""")
def unescaped_titles(spark, d):
    raw = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return (table(spark, d, "pages").withColumn("raw", raw)
            .select("page_id", text.unescape_entities(F.col("raw")).alias("title")))


@query("slugs", r"""
    SELECT page_id, regexp_replace(replace(lower(t), ' ', '-'), '[^\p{L}\p{N}_-]', '', 'g') AS slug
    FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""")
def slugs(spark, d):
    raw = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return (table(spark, d, "pages").withColumn("raw", raw)
            .select("page_id", text.slug(F.col("raw")).alias("slug")))


_NOW = "TIMESTAMP '2001-08-02 12:30:00'"
_S = f"(epoch({_NOW})::BIGINT - epoch(ts)::BIGINT)"


@query("relative_times", f"""
    SELECT k, CASE WHEN {_S} > 750 * 86400 THEN ({_S} // (365 * 86400)) || ' years ago'
      WHEN {_S} > 60 * 86400 THEN ({_S} // (30 * 86400)) || ' months ago'
      WHEN {_S} > 2 * 86400 THEN ({_S} // 86400) || ' days ago'
      WHEN {_S} > 7200 THEN ({_S} // 3600) || ' hours ago'
      WHEN {_S} > 3600 THEN 'an hour ago' ELSE 'recently added' END AS relative,
      CASE WHEN {_S} > 86400 THEN printf('%.2f', {_S} / 86400.0::DOUBLE) || ' day(s) ago'
      WHEN {_S} > 3600 THEN printf('%.2f', {_S} / 3600.0::DOUBLE) || ' hour(s) ago'
      WHEN {_S} > 60 THEN printf('%.2f', {_S} / 60.0::DOUBLE) || ' minutes(s) ago'
      WHEN {_S} > 1 THEN {_S} || ' second(s) ago'
      WHEN {_S} > 0 THEN 'just now'
      WHEN {_S} < -86400 THEN 'in ' || printf('%.2f', -{_S} / 86400.0::DOUBLE) || ' day(s)'
      WHEN {_S} < -3600 THEN 'in ' || printf('%.2f', -{_S} / 3600.0::DOUBLE) || ' hour(s)'
      WHEN {_S} < -60 THEN 'in ' || printf('%.2f', -{_S} / 60.0::DOUBLE) || ' minutes(s)'
      WHEN {_S} < -1 THEN 'in ' || (-{_S}) || ' second(s)' ELSE 'now' END AS approx
    FROM (SELECT o_orderkey AS k,
                 o_orderdate + to_seconds(o_custkey * 97) AS ts FROM orders)""")
def relative_times(spark, d):
    now = F.lit("2001-08-02 12:30:00").cast("timestamp")
    ts = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
                             + F.col("o_custkey") * 97)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), ts.alias("ts"))
    return rows.select("k", dates.relative_time(F.col("ts"), now).alias("relative"),
                       dates.approx_time(F.col("ts"), now).alias("approx"))


@query("format_functions", """
    SELECT o_orderkey AS k, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS thousands,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS rfc3339,
           strftime(o_orderdate, '%a, %-d %b %Y %H:%M:%S +0000') AS rfc2822,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S UTC') AS absolute,
           epoch(o_orderdate + INTERVAL 7 MONTH)::BIGINT AS plus_months_s,
           epoch(o_orderdate - INTERVAL 45 DAY)::BIGINT AS minus_days_s,
           epoch(make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), 0, 0, 0))
             ::BIGINT AS parts_s,
           epoch(o_orderdate)::BIGINT AS loose_s, epoch(o_orderdate)::BIGINT AS mail_s
    FROM orders""")
def format_functions(spark, d):
    ts = F.col("ts")
    rows = table(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    loose = dates.parse_rfc3339_loose(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    mail = dates.parse_rfc2822(dates.to_rfc2822(ts))
    return rows.select(
        F.col("o_orderkey").alias("k"),
        dates.thousands(F.floor("o_totalprice")).alias("thousands"),
        dates.to_rfc3339(ts).alias("rfc3339"), dates.to_rfc2822(ts).alias("rfc2822"),
        dates.absolute_time(ts).alias("absolute"),
        F.unix_seconds(dates.add_months(ts, 7)).alias("plus_months_s"),
        F.unix_seconds(dates.add_days(ts, -45)).alias("minus_days_s"),
        F.unix_seconds(dates.from_parts(F.year(ts), F.month(ts), F.dayofmonth(ts)))
        .alias("parts_s"),
        F.unix_seconds(loose).alias("loose_s"), F.unix_seconds(mail).alias("mail_s"))


# A query log: every page URL, its bare form, its host, and every part name and word.
cte("query_log", r"""
    SELECT url AS search FROM pages
    UNION ALL SELECT regexp_replace(url, '^https?://', '') FROM pages
    UNION ALL SELECT ' ' || regexp_extract(url, '://([^/]*)', 1) || ' ' FROM pages
    UNION ALL SELECT p_name FROM part
    UNION ALL SELECT upper(unnest(string_split(p_name, ' '))) FROM part
    UNION ALL SELECT p_brand FROM part
    UNION ALL SELECT p_type || ': ' || p_name FROM part
    UNION ALL SELECT repeat('*', p_size % 4) FROM part""")
_KNOWN = {"gizmo": "gizmo", "ring": "ringtag", "plate": "anvil", "anvil": "anvil",
          "bolt": "bolt", "widget": "widget", "gear": "gear", "steel": "steel"}
_MAP = "CASE lower(s) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KNOWN.items()) + " END"
_URLISH = "CASE WHEN contains(s, ':') THEN s ELSE 'http://' || s END"


@query("classify_queries", assemble(
    rf"""SELECT kind, text, alt, count(*) AS n FROM (
      SELECT kind, CASE kind WHEN '' THEN '' WHEN 'tag' THEN coalesce(tag, lower(s))
               WHEN 'url' THEN norm WHEN 'domain' THEN host ELSE s END AS text,
             CASE WHEN kind = 'tag' AND tag <> lower(s) THEN lower(s) END AS alt
      FROM (SELECT *, CASE WHEN NOT regexp_matches(s, '[\p{{L}}\p{{N}}]') THEN ''
              WHEN tag IS NOT NULL THEN 'tag'
              WHEN host IS NOT NULL AND NOT regexp_matches(host, '[^\p{{L}}\p{{N}}.-]')
                AND regexp_matches(host, '[\p{{L}}\p{{N}}-]')
              THEN CASE WHEN contains(s, '/') THEN 'url' ELSE 'domain' END
              WHEN NOT regexp_matches(s, '[^\p{{L}}\p{{N}}]') THEN 'tag' ELSE 'text' END AS kind
            FROM (SELECT s, {_MAP} AS tag,
                    CASE WHEN contains(s, '.') OR contains(s, ':') THEN {host(_URLISH)} END AS host,
                    {norm(_URLISH)} AS norm
                  FROM (SELECT trim(search) AS s FROM query_log)))) GROUP BY ALL""", "query_log"))
def classify_queries(spark, d):
    pages, part = table(spark, d, "pages"), table(spark, d, "part")
    log = [
        pages.select(F.col("url").alias("search")),
        pages.select(F.regexp_replace("url", "^https?://", "").alias("search")),
        pages.select(F.concat(F.lit(" "), F.regexp_extract("url", "://([^/]*)", 1),
                              F.lit(" ")).alias("search")),
        part.select(F.col("p_name").alias("search")),
        part.select(F.explode(F.split(F.upper("p_name"), " ")).alias("search")),
        part.select(F.col("p_brand").alias("search")),
        part.select(F.concat("p_type", F.lit(": "), "p_name").alias("search")),
        part.select(F.repeat(F.lit("*"), F.col("p_size") % 4).alias("search")),
    ]
    whole = log[0]
    for more in log[1:]:
        whole = whole.unionByName(more)
    return (search.classify(whole, CFG.tags).groupBy("kind", "text", "alt")
            .agg(F.count(F.lit(1)).alias("n")))


@query("tag_sets", assemble(
    """SELECT url_norm, array_to_string(list_sort(list_distinct(flatten(list(
                list_transform(coalesce(tags, CAST([] AS VARCHAR[])), lambda t: lower(t)))))), ',')
                AS tags,
              list_contains(list_distinct(flatten(list(list_transform(
                coalesce(tags, CAST([] AS VARCHAR[])), lambda t: lower(t))))), 'java') AS has_java
       FROM core GROUP BY url_norm""", "core"))
def tag_sets(spark, d):
    rows = urls.with_url_keys(scrapes(spark, d)).select(
        "url_norm", F.explode_outer("tags").alias("t"))
    sets = rows.groupBy("url_norm").agg(F.collect_set(F.lower("t")).alias("t"))
    return sets.select("url_norm", joined(F.sort_array("t")).alias("tags"),
                       F.array_contains("t", "java").alias("has_java"))
