"""Raw site payloads to scrapes, with warnings as a second output.

Input: payloads(payload, source, url, status, body, fetched_at). Every parser is native:
JSON and XML readers for reddit and lobsters, patterns over exploded rows for the two HTML
sites. A failed fetch or a bad record becomes a warning row, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import EngineConfig, SourceConfig
from ..functions import dates, ids, text, urls
from ..functions.months import month_of
from ..schema import RSS_CHANNEL
from ..session import settled
from . import html

# Field -> JSON type of a listing's post. Another type counts as missing: the text of a number
# is no title, and a number in quotes is no counter.
_TEXT, _NUMBER = "^STRING$", "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
_POST = {"id": (_TEXT, "string"), "subreddit": (_TEXT, "string"), "stickied": ("^BOOLEAN$", "boolean"),
         "created_utc": (_NUMBER, "double"), "url": (_TEXT, "string"), "title": (_TEXT, "string"),
         "num_comments": (_NUMBER, "double"), "score": (_NUMBER, "double"), "downs": (_NUMBER, "double"),
         "ups": (_NUMBER, "double"), "upvote_ratio": (_NUMBER, "double"), "link_flair_text": (_TEXT, "string")}


def _typed(doc: Column, path: str, shape: str, kind: str) -> Column:
    """A JSON value if it has that type, else null."""
    own = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    return F.when(own.rlike(shape), F.try_variant_get(doc, path, kind))


@dataclass
class Parsed:
    """``rows`` holds both outputs, for who needs both of one pass: scrapes are the ``accepted``
    rows, the others are warnings, which have no scrape columns but the source."""

    rows: DataFrame  # payload, accepted, message, then the scrape columns

    @property
    def scrapes(self) -> DataFrame:
        return self.rows.where("accepted").drop("accepted", "message")

    @property
    def warnings(self) -> DataFrame:
        return self.rows.where(~F.col("accepted")).select("payload", "source", "message")


def _row(source: str, message: Column, **values: Column) -> list[Column]:
    """Scrape columns in table order, of rows without a message; what a source lacks is null."""
    kinds = {"position": "bigint", "points": "bigint", "comments": "bigint", "score": "bigint",
             "upvotes": "bigint", "downvotes": "bigint", "upvote_ratio": "float",
             "flair": "string", "tags": "array<string>", "subsource": "string"}
    values.setdefault("subsource", F.lit(None))
    fine = message.isNull()
    out = [F.when(fine, month_of(values["date"])).alias("shard"),
           F.when(fine, ids.scrape_id(F.lit(source), values["subsource"].cast("string"), values["id"]))
           .alias("scrape_id"), F.lit(source).alias("source")]
    for name in ("subsource", "id", "url", "raw_title", "date", *list(kinds)[:-1]):
        v = values.get(name, F.lit(None))
        out.append(F.when(fine, v.cast(kinds[name]) if name in kinds else v).alias(name))
    return [F.col("payload"), fine.alias("accepted"), message.alias("message"), *out]


def _marked(rows: DataFrame, source: str, message: Column, **values: Column) -> DataFrame:
    """Rows without a message are scrapes, the others warnings."""
    marked = settled(rows.withColumn("_message", message))
    return marked.select(*_row(source, F.col("_message"), **values))


def _read_once(payloads: DataFrame, doc: Column, name: str) -> DataFrame:
    """As ``settled``, for a body's document; the payload stays a plain column, so that rows which
    lie together by it are not shuffled again."""
    return payloads.select("payload", F.explode(F.array(doc)).alias(name))


def _items(items: Column, broken: Column) -> Column:
    """Each item and its place; a broken body is one item that is null, for its warning."""
    return F.posexplode(F.when(broken, F.array(F.lit(None))).otherwise(items)).alias("_pos", "_c")


def _only_warnings(payloads: DataFrame, source: Column, message: Column) -> DataFrame:
    return payloads.select("payload", F.lit(False).alias("accepted"), message.alias("message"), source.alias("source"))


def _with_warnings(rows: DataFrame, warnings: DataFrame) -> DataFrame:
    return rows.unionByName(warnings, allowMissingColumns=True)


def _missing(**checks: Column) -> Column:
    """Message of the first check that fails, in order; null when all hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m.replace("_", " ")))
                        for m, ok in checks.items()])


def parse_reddit(payloads: DataFrame) -> Parsed:
    """Listing JSON. The position counts accepted posts per subreddit of the payload, and
    a post that fails a later check still uses its position."""
    listed = F.try_variant_get(F.try_parse_json("body"), "$.data.children", "array<variant>")
    parsed = _read_once(payloads, listed, "_kids")
    kids, child = F.col("_kids"), F.col("_c")
    posts = (parsed.select("payload", kids.isNull().alias("_broken"), _items(kids, kids.isNull()))
             .select("payload", "_broken", "_pos", _typed(child, "$.kind", _TEXT, "string").alias("kind"),
                     *[_typed(child, f"$.data.{name}", *how).alias(name) for name, how in _POST.items()]))
    posts = posts.withColumn("subreddit", F.lower("subreddit"))
    early = F.coalesce(
        F.when(F.col("_broken"), "Missing children element"),
        F.when(F.coalesce(F.col("kind") != "t3", F.lit(True)), "Unknown story type"),
        F.when(F.col("id").isNull(), "Missing field id"),
        F.when(F.col("subreddit").isNull(), "Missing field subreddit"),
        F.when(F.col("stickied"), "Ignoring stickied story"))
    order = Window.partitionBy("payload", "subreddit").orderBy("_pos")
    posts = (posts.withColumn("_early", early)
             .withColumn("position", F.sum(F.col("_early").isNull().cast("int")).over(order)))

    def u32(name: str) -> Column:
        v = F.col(name).cast("bigint")  # truncates, as a number with a fraction must
        return v.between(0, 4294967295)

    clean_url = text.unescape_entities(F.col("url"))
    posts = posts.withColumn("_url", clean_url)
    message = F.coalesce("_early", _missing(
        Missing_field_created_utc=F.col("created_utc").isNotNull(),
        Unmappable_URL=urls.host(F.col("_url")).isNotNull(),
        Missing_field_title=F.col("title").isNotNull(),
        Bad_integer_num_comments=u32("num_comments"), Bad_integer_score=u32("score"),
        Bad_integer_downs=u32("downs"), Bad_integer_ups=u32("ups"),
        Bad_number_upvote_ratio=F.col("upvote_ratio").isNotNull()))
    return Parsed(_marked(
        posts, "reddit", message, id=F.col("id"), subsource=F.col("subreddit"), url=F.col("_url"),
        raw_title=text.unescape_entities(F.col("title")),
        date=F.timestamp_seconds(F.col("created_utc").cast("bigint")),
        position=F.col("position"), comments=F.col("num_comments"), score=F.col("score"),
        upvotes=F.col("ups"), downvotes=F.col("downs"), upvote_ratio=F.col("upvote_ratio"),
        flair=text.unescape_entities(F.coalesce("link_flair_text", F.lit("")))))


def parse_lobsters(payloads: DataFrame) -> Parsed:
    """RSS channel; the position is the item's place in the channel."""
    parsed = _read_once(payloads, F.from_xml("body", RSS_CHANNEL), "_doc")
    broken = F.col("_doc.channel").isNull()
    rows = (parsed.select("payload", broken.alias("_broken"), _items(F.col("_doc.channel.item"), broken))
            .select("payload", "_broken", "_pos", "_c.*"))
    rows = (rows.withColumn("_id", F.regexp_replace("guid._VALUE", "^(https://lobste.rs/s/)+", ""))
            .withColumn("_date", dates.parse_rfc2822(F.col("pubDate"))))
    complete = (F.col("title").isNotNull() & F.col("_id").isNotNull()
                & urls.host(F.col("link")).isNotNull() & F.col("_date").isNotNull())
    message = F.coalesce(F.when(F.col("_broken"), "Missing channel element"),
                         _missing(Story_did_not_contain_all_required_fields=complete))
    return Parsed(_marked(
        rows, "lobsters", message, id=F.col("_id"), url=F.col("link"), raw_title=F.col("title"),
        date=F.col("_date"), comments=F.lit(0), score=F.lit(0), position=F.col("_pos") + 1,
        tags=F.coalesce("category", F.array().cast("array<string>"))))


def _hacker_news_lines(payloads: DataFrame) -> DataFrame:
    """One row per table row of the page, typed story, info or neither."""
    rows = (payloads.select(
        "payload", F.posexplode(F.split("body", r"(?i)<tr(?=[\s>])", -1)).alias("_pos", "seg"))
        .where(F.col("_pos") > 0))
    seg = F.col("seg")
    story, info = F.col("kind") == "story", F.col("kind") == "info"
    rows = rows.withColumn(
        "kind", F.when(seg.rlike(r"(?i)<table\b"), "table")
        .when(html.has_class(seg, "titleline"), "story")
        .when(html.has_class(seg, "subtext"), "info").otherwise("other"))
    # In steps, so every pattern runs once per line and only on lines of its kind.
    rows = rows.withColumns({
        "_link": F.when(story, html.first_link(html.after_class(seg, "titleline"))),
        "_talk": F.when(info, F.filter(html.links(seg), lambda a: a["text"].contains("comment")
                                       | a["text"].contains("discuss"))),
        "_score": F.when(info, html.attrs_of(seg, "score")),
        "_age": F.when(info, html.attr(html.attrs_of(seg, "age"), "title"))})
    rows = rows.withColumns({
        "_href": html.attr(F.col("_link.attrs"), "href"),
        "_last": F.try_element_at("_talk", F.lit(-1))["text"]})
    rows = rows.withColumn("_href", text.unescape_entities(F.col("_href")))
    last, age = F.col("_last"), F.col("_age")
    return rows.select(
        "payload", "_pos", "kind",
        F.when(story, html.attr(F.regexp_extract(seg, "^([^>]*)", 1), "id"))
        .otherwise(F.regexp_replace(html.attr(F.col("_score"), "id"), "^(score_)+", ""))
        .alias("id"),
        F.when(story, html.has_class(seg, "votelinks")).alias("votes"),
        F.when(F.col("_href").startswith("item?"),
               F.concat(F.lit("https://news.ycombinator.com/"), "_href"))
        .otherwise(F.col("_href")).alias("url"),
        text.unescape_entities(F.col("_link.text")).alias("raw_title"),
        F.when(story, F.rtrim(F.regexp_extract(
            html.after_class(seg, "rank"), r"^([^<]*)", 1), F.lit(".")).try_cast("bigint"))
        .alias("position"),
        dates.parse_rfc3339_loose(F.when(age.endswith("Z"), age)
                                  .otherwise(F.concat(age, F.lit("Z")))).alias("date"),
        F.when(info, html.digits(F.regexp_extract(
            html.after_class(seg, "score"), "^([^<]*)", 1))).alias("points"),
        F.when(last.contains("comment"), html.digits(last))
        .when(last.isNotNull(), F.lit(0)).alias("comments"))


def parse_hacker_news(payloads: DataFrame) -> Parsed:
    """Story lines paired with info lines by id; a story line without one is a warning."""
    lines = _hacker_news_lines(payloads)
    message = (
        F.when(F.col("kind") == "table", "Story table cannot contain other tables")
        .when(F.col("kind") == "story", _missing(
            Missing_votelinks=F.col("votes"), Failed_to_get_href=F.col("url").isNotNull(),
            Failed_to_parse_URL=urls.host(F.col("url")).isNotNull(),
            Failed_to_get_id_node=F.col("id").isNotNull(),
            Failed_to_parse_rank=F.col("position").isNotNull()))
        .when(F.col("kind") == "info", _missing(
            Failed_to_map_date=F.col("date").isNotNull(),
            Missing_ID_on_score_node=F.col("id").isNotNull(),
            Failed_to_parse_points=F.col("points").isNotNull(),
            Missing_comment_count=F.col("comments").isNotNull()))
        .otherwise("Unknown node type"))
    lines = settled(lines.withColumn("_message", message))
    # The inner join of story and info lines by id, as one grouping: of two lines with one
    # id the later stands, and a story without an info line is unmatched. Lines with a
    # message go along, counted, so that one pass over the lines makes scrapes and warnings.
    bad = F.col("_message").isNotNull()
    pairs = lines.groupBy("payload", "id", "_message").agg(
        F.max(F.when(F.col("kind") == "story", F.struct(
            "_pos", "url", "raw_title", "position"))).alias("s"),
        F.max(F.when(F.col("kind") == "info", F.struct(
            "_pos", "date", "points", "comments"))).alias("i"),
        F.count("_message").alias("n")).where(bad | F.col("s").isNotNull())
    pairs = pairs.select(
        "payload", "id", "s.url", "s.raw_title", "s.position", "i.date", "i.points", "i.comments",
        F.when(bad, F.col("_message")).when(F.col("i").isNull(), F.concat(
            F.lit("Unmatched story/info for id "), "id")).alias("_message"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)))))
    return Parsed(pairs.select(*_row("hacker_news", F.col("_message"), **{c: F.col(c) for c in (
        "id", "url", "raw_title", "date", "position", "points", "comments")})))


def slashdot_topic(href: Column) -> Column:
    """Value of the ``fhfilter`` argument, null without one."""
    pattern = r"[?&]fhfilter=([^&#]*)"
    return F.when(href.rlike(pattern), F.try_url_decode(F.regexp_extract(href, pattern, 1)))


def parse_slashdot(payloads: DataFrame, cfg: SourceConfig = SourceConfig()) -> Parsed:
    """Articles of the front page: the second link of the title is the story's URL."""
    rows = (payloads.select(
        "payload", F.posexplode(F.split("body", r"(?i)<article(?=[\s>])", -1)).alias("_pos", "seg"))
        .where((F.col("_pos") > 0) & F.col("seg").rlike(
            r"""(?is)^[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?article(?:\s[^"']*)?["']""")))
    seg = F.regexp_extract("seg", r"(?is)^(.*?)(?:</article|$)", 1)
    rows = rows.select("payload", seg.alias("seg"))
    head = F.regexp_extract(html.after_class(F.col("seg"), "story-title"),
                            r"(?is)^(.*?)(?:</h2|</header|comment-bubble|<div\b|$)", 1)
    rows = rows.withColumn("_head", head).withColumn("_links", html.links(F.col("_head")))
    rows = rows.withColumns({
        "_first": F.get("_links", F.lit(0)), "_second": F.get("_links", F.lit(1))})
    rows = rows.withColumns({
        "_href": html.attr(F.col("_first.attrs"), "href"),
        "_ext": html.attr(F.col("_second.attrs"), "href"),
        "_bubble": html.strip_tags(F.regexp_extract(
            html.after_class(F.col("seg"), "comment-bubble"), r"(?is)^(.*?)(?:</span|</div|$)", 1)),
        "_when": html.strip_tags(F.regexp_extract(
            "seg", r"(?is)<time\b[^>]*>(.*?)</time", 1))})
    story_href = F.col("_href")
    id_re = r"/story/([^/]*/[^/]*/[^/]*/[^/]*)"
    bubble = F.col("_bubble")
    topic = F.regexp_extract(html.after_class(F.col("seg"), "topic"),
                             r"(?is)^(.*?)(?:</span|</div|$)", 1)
    topics = F.array_compact(F.transform(
        html.links(topic), lambda a: slashdot_topic(html.attr(a["attrs"], "href"))))
    rows = rows.select(
        "payload", "_head", F.size("_links").alias("_n"),
        html.has_class(F.col("seg"), "comment-bubble").alias("_talked"),
        html.has_class(F.col("seg"), "topic").alias("_topical"),
        text.unescape_entities(F.col("_first.text")).alias("raw_title"), "_href",
        F.when(story_href.rlike(id_re), F.regexp_extract(story_href, id_re, 1)).alias("id"),
        text.unescape_entities(F.col("_ext")).alias("url"),
        F.when(bubble.rlike("^[0-9]{1,10}$"), bubble.cast("bigint")).alias("_count"),
        topics.alias("tags"),
        dates.parse_slashdot_time(F.col("_when"), cfg.slashdot_times_are_eastern).alias("date"))
    message = _missing(**{
        "Missing .story-title": F.col("_head") != "",
        "Missing story link": F.col("_n") >= 1,
        "Title was too short": F.octet_length("raw_title") >= 5,
        "Missing story href": F.col("_href").isNotNull(),
        "Invalid link format": F.col("id").isNotNull(),
        "Missing external link": F.col("_n") >= 2,
        "Invalid href": urls.host(F.col("url")).isNotNull(),
        "Failed to parse number of comments": ~F.col("_talked") | F.col("_count").isNotNull(),
        "Missing topics": F.col("_topical"),
        "Failed to parse date": F.col("date").isNotNull()})
    return Parsed(_marked(
        rows, "slashdot", message, id=F.col("id"), url=F.col("url"), raw_title=F.col("raw_title"),
        date=F.col("date"), comments=F.coalesce("_count", F.lit(0)), tags=F.col("tags")))


# Source name -> parser of its payloads. A further source is an entry of its own.
PARSERS: dict[str, Callable[[DataFrame, EngineConfig], Parsed]] = {
    "hacker_news": lambda rows, cfg: parse_hacker_news(rows),
    "reddit": lambda rows, cfg: parse_reddit(rows),
    "lobsters": lambda rows, cfg: parse_lobsters(rows),
    "slashdot": lambda rows, cfg: parse_slashdot(rows, cfg.sources),
}


def scrape_payloads(payloads: DataFrame, cfg: EngineConfig = EngineConfig(),
                    parsers: dict[str, Callable[[DataFrame, EngineConfig], Parsed]] | None = None) -> Parsed:
    """Dispatch on source. A payload with an HTTP error, or of a source without a parser, is
    one warning row, so every payload leaves a trace."""
    parsers = PARSERS if parsers is None else parsers
    ok = payloads.where(F.col("status") == 200)
    parts = [parse(ok.where(F.col("source") == name), cfg) for name, parse in parsers.items()]
    strange = _only_warnings(
        ok.where(~F.coalesce(F.col("source").isin(*parsers), F.lit(False))), F.col("source"),
        F.concat(F.lit("No parser for source "), F.coalesce("source", F.lit("null"))))
    failed = _only_warnings(
        payloads.where(F.coalesce(F.col("status") != 200, F.lit(True))), F.col("source"),
        F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("error")), F.lit(" for "), "url"))
    rows = parts[0].rows
    for p in parts[1:]:
        rows = rows.unionByName(p.rows)
    return Parsed(_with_warnings(_with_warnings(rows, failed), strange))
