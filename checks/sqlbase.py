"""DuckDB building blocks: named CTEs with dependencies, assembled per twin."""

from __future__ import annotations

from linkloom.config import LOBSTERS_DENIED_TAGS, SLASHDOT_TAGS, SUBREDDITS
from linkloom.sources.derived import FLAIR_CYCLE, SUBREDDIT_CYCLE, TAG_CYCLE

URL_RE = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def sql_list(values) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values, index: str) -> str:
    return f"{sql_list(values)}[({index}) % {len(values)} + 1]"


def authority(url: str) -> str:
    return (rf"regexp_replace(regexp_replace(lower(regexp_extract({url}, '{URL_RE}', 2)),"
            rf" '^.*@', ''), '^(?:www[0-9]*|m)\.([^.]+\..*)$', '\1')")


def host(url: str) -> str:
    return f"nullif(regexp_replace({authority(url)}, ':[0-9]*$', ''), '')"


def norm(url: str) -> str:
    args = (rf"array_to_string(list_sort(list_filter(string_split(substr(regexp_extract({url},"
            rf" '{URL_RE}', 4), 2), '&'), lambda a: a <> '' AND NOT regexp_matches(a,"
            r" '^(utm_[^=]*|gclid|fbclid|ref)(=.*)?$'))), '&')")
    return (rf"CASE WHEN {host(url)} IS NOT NULL THEN"
            rf" regexp_replace({authority(url)}, ':(80|443)?$', '')"
            rf" || regexp_replace(regexp_extract({url}, '{URL_RE}', 3), '(/index\.html)?/*$', '')"
            rf" || CASE WHEN {args} <> '' THEN '?' || {args} ELSE '' END END")


def story_id(date: str, norm_: str) -> str:
    text = f"year({date}) || ':' || month({date}) || ':' || day({date}) || ':' || {norm_}"
    return (f"rtrim(replace(replace(to_base64(encode({text})), '+', '-'), '/', '_'), '=')")


def month_label(shard: str) -> str:
    return f"printf('%04d-%02d', ({shard}) // 12, ({shard}) % 12 + 1)"


def unescape(t: str) -> str:
    dec = ("CASE e WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>'"
           " WHEN '&quot;' THEN '\"' WHEN '&squot;' THEN '''' WHEN '&nbsp;' THEN chr(160)"
           " ELSE e END")
    ents = f"list_transform(regexp_extract_all({t}, '&[^;]*;'), lambda e: {dec})"
    lits = f"string_split_regex({t}, '&[^;]*;')"
    return (f"array_to_string(list_transform(range(1, len({lits}) + 1), lambda i:"
            f" CASE WHEN i = len({lits}) AND regexp_matches({lits}[i], '^[^&]*&$')"
            f" THEN rtrim({lits}[i], '&') ELSE {lits}[i] END || coalesce({ents}[i], '')), '')")


def edge_tags(t: str) -> str:
    head = f"regexp_replace(trim({t}), '^\\[[A-Za-z]{{1,9}}\\]', '')"
    tail = f"regexp_replace({head}, '\\[[A-Za-z]{{1,9}}\\]$', '')"
    return (f"CASE WHEN trim({head}) = '' OR trim({tail}) = '' THEN trim({t})"
            f" ELSE trim({tail}) END")


IS_TAG = sql_list([s for s, o in SUBREDDITS.items() if o.get("is_tag")])
FLAIR_TAG = sql_list([s for s, o in SUBREDDITS.items() if o.get("flair_is_tag")])

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (body, deps)


def assemble(final: str, *names: str) -> str:
    """``WITH RECURSIVE`` over the named CTEs and everything they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for d in CTES[n][1]:
                visit(d)
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return final
    parts = ",\n".join(f"{_head(n)} AS {_mat(n)}({CTES[n][0]})" for n in order)
    return f"WITH RECURSIVE {parts}\n{final}"


_COLUMN_LISTS = {"anchors": "anchors(url_norm, anchor)"}


def _head(name: str) -> str:
    return _COLUMN_LISTS.get(name, name)


def _mat(name: str) -> str:
    return "" if name in _COLUMN_LISTS or name.endswith("_rec") else "MATERIALIZED "


cte("raw", r"""
    SELECT o.*, p.url, pt.p_name,
           regexp_extract(p.html, '<title>([^<]*)</title>', 1) AS page_title,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'hacker_news' WHEN '2-HIGH' THEN 'lobsters'
                WHEN '3-MEDIUM' THEN 'reddit' WHEN '4-NOT SPECIFIED' THEN 'slashdot'
                ELSE 'feed' END AS source
    FROM orders o
    JOIN pages p ON p.page_id = o.o_orderkey % (SELECT count(*) FROM pages)
    JOIN part pt ON pt.p_partkey = o.o_orderkey % (SELECT count(*) FROM part)""")
cte("titled", """
    SELECT *, CASE o_orderkey % 7 WHEN 0 THEN 'Show HN: ' WHEN 1 THEN 'Ask HN: '
                   WHEN 2 THEN '[note] ' ELSE '' END
              || page_title || ' ' || p_name
              || CASE o_orderkey % 11 WHEN 0 THEN ' [pdf]' WHEN 1 THEN ' [video]' ELSE '' END
              AS coded_title
    FROM raw""", "raw")
cte("scrapes", f"""
    SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS shard, source, subsource,
           CAST(o_orderkey AS VARCHAR) AS id, url, coded_title,
           {unescape('coded_title')} AS raw_title, o_orderdate AS date,
           CASE WHEN source IN ('hacker_news', 'reddit', 'lobsters') THEN o_orderkey % 40 END
             AS position,
           CASE WHEN source = 'hacker_news' THEN vol % 200 END AS points,
           CASE WHEN source <> 'feed' THEN o_custkey % 200 END AS comments,
           CASE WHEN source IN ('reddit', 'lobsters') THEN vol % 300 END AS score,
           CASE WHEN source = 'reddit' THEN vol % 20 END AS upvotes,
           CASE WHEN source = 'reddit' THEN vol % 3 END AS downvotes,
           CASE WHEN source = 'reddit' THEN (vol % 4) * 0.25 END AS upvote_ratio,
           CASE WHEN source = 'reddit' THEN {pick(FLAIR_CYCLE, 'o_custkey')} END AS flair,
           CASE WHEN source IN ('lobsters', 'slashdot', 'feed') THEN
             CASE WHEN t1 = t2 THEN [t1] ELSE [t1, t2] END END AS tags,
           o_orderkey AS seq,
           source || coalesce('-' || subsource, '') || '-' || o_orderkey AS scrape_id
    FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS vol,
                 CASE WHEN source = 'reddit' THEN {pick(SUBREDDIT_CYCLE, 'o_custkey')} END
                   AS subsource,
                 {pick(TAG_CYCLE, 'o_orderkey')} AS t1, {pick(TAG_CYCLE, 'o_custkey')} AS t2
          FROM titled)""", "titled")
cte("core", f"""
    SELECT *, CASE WHEN source = 'reddit' THEN {edge_tags('raw_title')} ELSE raw_title END AS title,
           CASE WHEN position > 0 THEN position - 1 END AS rank,
           CASE source
             WHEN 'hacker_news' THEN list_filter([
               CASE WHEN starts_with(raw_title, 'Show HN') THEN 'show' END,
               CASE WHEN starts_with(raw_title, 'Ask HN') THEN 'ask' END,
               CASE WHEN suffix(raw_title, '[pdf]') THEN 'pdf' END,
               CASE WHEN suffix(raw_title, '[video]') THEN 'video' END],
               lambda x: x IS NOT NULL)
             WHEN 'reddit' THEN list_filter([
               CASE WHEN list_contains({FLAIR_TAG}, subsource) AND flair <> ''
                     AND NOT contains(flair, ' ') THEN lower(flair) END,
               CASE WHEN list_contains({IS_TAG}, subsource) THEN subsource END],
               lambda x: x IS NOT NULL)
             WHEN 'slashdot' THEN list_filter(tags, lambda t:
               list_contains({sql_list(SLASHDOT_TAGS)}, t))
             WHEN 'lobsters' THEN list_filter(tags, lambda t:
               NOT list_contains({sql_list(LOBSTERS_DENIED_TAGS)}, t))
             ELSE tags END AS core_tags
    FROM (SELECT *, {host('url')} AS host, {norm('url')} AS url_norm FROM scrapes)
    WHERE url_norm IS NOT NULL""", "scrapes")
cte("months", "SELECT DISTINCT url_norm, shard FROM core", "core")
cte("anchors", """
    SELECT url_norm, min(shard) FROM months GROUP BY url_norm
    UNION ALL
    SELECT a.url_norm, (SELECT min(m.shard) FROM months m
                        WHERE m.url_norm = a.url_norm AND m.shard > a.anchor + 2)
    FROM anchors a
    WHERE EXISTS (SELECT 1 FROM months m
                  WHERE m.url_norm = a.url_norm AND m.shard > a.anchor + 2)""", "months")
cte("clustered", """
    SELECT c.*, (SELECT max(a.anchor) FROM anchors a
                 WHERE a.url_norm = c.url_norm AND a.anchor <= c.shard) AS anchor
    FROM core c""", "core", "anchors")

TERMS = {
    "Position": "CASE WHEN rank IS NOT NULL THEN (30 - least(greatest(rank, 0), 30)) *"
                " CASE source WHEN 'hacker_news' THEN 1.2::DOUBLE WHEN 'reddit' THEN 0.7::DOUBLE"
                " WHEN 'lobsters' THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END END",
    "Source": "CASE WHEN source = 'slashdot' THEN 5.0::DOUBLE END",
    "ImageLink": "CASE WHEN contains(host, 'gfycat') OR contains(host, 'imgur')"
                 " OR contains(host, 'i.reddit.com')"
                 " THEN CASE WHEN source = 'hacker_news' THEN -5.0::DOUBLE ELSE -10.0::DOUBLE END"
                 " END",
    "CommentCount": "CASE WHEN source IN ('hacker_news', 'lobsters', 'slashdot')"
                    " AND comments > 100 THEN 5.0::DOUBLE"
                    " WHEN source = 'reddit' AND comments < 10 THEN -5.0::DOUBLE"
                    " WHEN source = 'reddit' AND comments > 10 THEN 5.0::DOUBLE END",
    "SelfLink": "CASE WHEN source = 'reddit' AND contains(host, 'reddit.com')"
                " THEN -20.0::DOUBLE END",
    "LongRedditTitle": "CASE WHEN source = 'reddit' AND strlen(title) > 130"
                       " THEN -5.0::DOUBLE END",
    "PoorUpvoteRatio": "CASE WHEN source = 'reddit' AND upvote_ratio < 0.6"
                       " THEN -20.0::DOUBLE END",
    "UpvoteCount": "CASE WHEN source = 'reddit' AND upvotes < 10 THEN -20.0::DOUBLE"
                   " WHEN source = 'reddit' AND upvotes > 10 THEN 10.0::DOUBLE END",
}
SINGLE = " + ".join(f"coalesce({t}, 0.0::DOUBLE)" for t in TERMS.values())

cte("scored", f"SELECT *, {SINGLE} AS single_score FROM clustered", "clustered")
cte("best", """
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY url_norm, anchor, source
                                   ORDER BY single_score DESC, scrape_id DESC) AS rn
      FROM scored) WHERE rn = 1""", "scored")
cte("rolled", """
    SELECT url_norm, anchor, min(date) AS date, count(*) AS n_scrapes,
           first(title ORDER BY CASE source WHEN 'hacker_news' THEN 0 WHEN 'feed' THEN 1
                 WHEN 'lobsters' THEN 2 WHEN 'slashdot' THEN 3 WHEN 'reddit' THEN 4 ELSE 99 END,
                 scrape_id) AS title,
           first(url ORDER BY date, scrape_id) AS url,
           first(host ORDER BY date, scrape_id) AS host
    FROM scored GROUP BY url_norm, anchor""", "scored")
JITTER = "((('0x' || substr(md5(url_norm), 1, 13))::BIGINT) % 6000000) / 1000000.0::DOUBLE"
cte("evaluated", f"""
    SELECT r.*, year(r.date) * 12 + month(r.date) - 1 AS shard,
           {story_id('r.date', 'r.url_norm')} AS story_id,
           {JITTER} + pow(r.n_scrapes, 1.2) * 5.0
             + CASE WHEN strlen(r.title) > 250 THEN -15.0 ELSE 0.0 END + b.total AS score
    FROM rolled r JOIN (SELECT url_norm, anchor, sum(single_score) AS total FROM best
                        GROUP BY ALL) b USING (url_norm, anchor)""", "rolled", "best")
# Title tags: words and multi-word entries by position, then a greedy scan.
cte("spelled", r"""
    SELECT url_norm, anchor, title,
           contains(lower(title), 'c++') AS s1, contains(lower(title), '***') AS s2,
           contains(lower(title), '%%%') AS s3,
           list_filter(list_transform(regexp_split_to_array(
             replace(replace(replace(replace(lower(title), '''s', ''), '%%%', ' '), '***', ' '),
                     'c++', ' '), '[ \t\n\r\f]+'),
             lambda w: regexp_replace(w, '[^\p{L}\p{N}-]', '', 'g')), lambda w: w <> '') AS w
    FROM rolled""", "rolled")


def scan_ctes(source: str, keys: str, prefix: str) -> None:
    """Scan of ``source(keys, w)``, written as a walk over word positions."""
    join = " AND ".join(f"s.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    skeys = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    # state: position, step number, last muted step per mutable word, tags so far
    word = "d.w[s.pos]"
    two = "d.w[s.pos] || ' ' || coalesce(d.w[s.pos + 1], '')"
    mute_ring = f"CASE WHEN {two} IN ('hot ring', 'cold ring') THEN s.turn + 1 ELSE s.ring END"
    mute_bolt = f"CASE WHEN {two} = 'red bolt' THEN s.turn + 1 ELSE s.bolt END"
    multi = (f"CASE {two} WHEN 'new gear' THEN ['widget'] WHEN 'old rod' THEN ['anvil']"
             " WHEN 'small rod' THEN ['steel'] END")
    single = (f"CASE WHEN {word} IN ('gizmo', 'gizmos') THEN ['gizmo', 'gadget']"
              f" WHEN {word} = 'ring' AND {mute_ring} < s.turn THEN ['ringtag']"
              f" WHEN {word} IN ('anvil', 'plate') THEN ['anvil']"
              f" WHEN {word} = 'bolts' OR ({word} = 'bolt' AND {mute_bolt} < s.turn)"
              f" THEN ['bolt']"
              f" WHEN {word} IN ('widget', 'new-gear') THEN ['widget']"
              f" WHEN {word} IN ('gear', 'steel', 'java', 'web') THEN [{word}]"
              f" WHEN {word} = 'go' THEN ['golang'] ELSE CAST([] AS VARCHAR[]) END")
    cte(f"{prefix}_rec", f"""
        SELECT {keys}, 1 AS pos, 1 AS turn, 0 AS ring, 0 AS bolt,
               CAST([] AS VARCHAR[]) AS tags FROM {source} WHERE len(w) > 0
        UNION ALL
        SELECT {skeys}, CASE WHEN {multi} IS NULL THEN s.pos + 1 ELSE s.pos + 2 END,
               s.turn + 1, {mute_ring}, {mute_bolt},
               list_concat(s.tags, coalesce({multi}, {single}))
        FROM {prefix}_rec s JOIN {source} d ON {join} WHERE s.pos <= len(d.w)""", source)
    cte(f"{prefix}_tags", f"""
        SELECT d.*, list_concat(coalesce(s.tags, CAST([] AS VARCHAR[])),
                 CASE WHEN s1 THEN ['cplusplus'] ELSE CAST([] AS VARCHAR[]) END,
                 CASE WHEN s2 THEN ['stars'] ELSE CAST([] AS VARCHAR[]) END,
                 CASE WHEN s3 THEN ['percent', 'maths'] ELSE CAST([] AS VARCHAR[]) END) AS found
        FROM {source} d LEFT JOIN (SELECT * FROM {prefix}_rec) s
          ON {join} AND s.pos > len(d.w)""", source, f"{prefix}_rec")


scan_ctes("spelled", "url_norm, anchor", "scan")
INTERNAL = ("CASE lower({t}) WHEN 'c++' THEN 'cplusplus' WHEN 'go' THEN 'golang'"
            " WHEN '***' THEN 'stars' WHEN '%%%' THEN 'percent' WHEN 'gizmos' THEN 'gizmo'"
            " WHEN 'ring' THEN 'ringtag' WHEN 'plate' THEN 'anvil' WHEN 'bolts' THEN 'bolt'"
            " WHEN 'new-gear' THEN 'widget' ELSE lower({t}) END")
cte("source_tags", f"""
    SELECT url_norm, anchor, list({INTERNAL.format(t='t')}) AS own
    FROM (SELECT url_norm, anchor, unnest(core_tags) AS t FROM scored) GROUP BY ALL""", "scored")
cte("stories", """
    SELECT e.*, list_sort(list_distinct(list_concat(s.found,
             coalesce(o.own, CAST([] AS VARCHAR[]))))) AS tags
    FROM evaluated e JOIN scan_tags s USING (url_norm, anchor)
    LEFT JOIN source_tags o USING (url_norm, anchor)""",
    "evaluated", "scan_tags", "source_tags")


def age(now: str, date: str) -> str:
    h = f"greatest(0.0::DOUBLE, (epoch_us({now}) - epoch_us({date})) / 3.6e9::DOUBLE)"
    return (f"CASE WHEN {h} < 24 THEN {h} * -5.0"
            f" WHEN {h} < 720 THEN 24 * -5.0 + ({h} - 24) * -3.0"
            f" ELSE 24 * -5.0 + 696 * -3.0 + ({h} - 720) * -0.1 END")


cte("candidates", """
    SELECT * FROM (
      SELECT *, (SELECT max(date) FROM stories) AS now FROM stories
      WHERE shard >= (SELECT max(shard) FROM stories) - 2
      ORDER BY shard DESC, date DESC, story_id LIMIT 2000)
    ORDER BY score DESC, date DESC, story_id LIMIT 1000""", "stories")
cte("hot", f"""
    SELECT *, row_number() OVER (ORDER BY CAST(trunc(aged_score * -1000.0) AS INTEGER),
                                 score DESC, date DESC, story_id) - 1 AS position
    FROM (SELECT *, score + {age('now', 'date')} AS aged_score FROM candidates)""", "candidates")
