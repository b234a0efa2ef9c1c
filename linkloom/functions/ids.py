"""Scrape ids, story ids and comment links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COMMENT_HOSTS, SOURCES


def scrape_id(source: Column, subsource: Column, id_: Column) -> Column:
    """``source[-subsource]-id``; a null subsource is left out."""
    return F.concat_ws("-", source, subsource, id_)


def parse_scrape_id(text: Column) -> Column:
    """Struct(source, subsource, id), or null for an unknown source or a bare word."""
    bits = F.split(text, "-", 3)
    source = F.get(bits, F.lit(0))
    known = source.isin(*SOURCES) & (F.size(bits) >= 2)
    return F.when(known, F.struct(
        source.alias("source"),
        F.when(F.size(bits) == 3, F.get(bits, F.lit(1))).alias("subsource"),
        F.when(F.size(bits) == 3, F.get(bits, F.lit(2)))
        .otherwise(F.get(bits, F.lit(1))).alias("id")))


def story_id(date: Column, norm: Column) -> Column:
    """``Y:M:D:norm`` in URL-safe base64 without padding."""
    text = F.concat_ws(":", F.year(date).cast("string"), F.month(date).cast("string"),
                       F.dayofmonth(date).cast("string"), norm)
    raw = F.base64(F.encode(text, "utf-8"))
    # Java's MIME encoder may wrap long output; the id has no line breaks.
    return F.translate(raw, "+/=\r\n", "-_")


def decode_story_id(text: Column) -> Column:
    """Struct(year, month, day, norm, shard); null when it is not a story id."""
    ok = text.rlike(r"^[A-Za-z0-9_-]+$")
    plain = F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64"))
    # Text that only looks like an id may decode to anything.
    bits = F.split(F.try_validate_utf8(plain.cast("string")), ":", 4)
    num = [F.try_element_at(bits, F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    norm = F.try_element_at(bits, F.lit(4))
    good = ok & num[0].isNotNull() & num[1].isNotNull() & num[2].isNotNull() & norm.isNotNull()
    return F.when(good, F.struct(
        num[0].alias("year"), num[1].alias("month"), num[2].alias("day"),
        norm.alias("norm"), (num[0] * 12 + num[1] - 1).cast("int").alias("shard")))


def story_id_matches_date(text: Column, date: Column) -> Column:
    d = decode_story_id(text)
    return ((d["year"] == F.year(date)) & (d["month"] == F.month(date))
            & (d["day"] == F.dayofmonth(date)))


def comments_url(source: Column, subsource: Column, id_: Column) -> Column:
    return (
        F.when(source == "hacker_news",
               F.concat(F.lit("https://news.ycombinator.com/item?id="), id_))
        .when(source == "slashdot",
              F.concat(F.lit("https://tech.slashdot.org/story/"), id_, F.lit("/")))
        .when(source == "lobsters", F.concat(F.lit("https://lobste.rs/s/"), id_, F.lit("/")))
        .when((source == "reddit") & subsource.isNotNull(),
              F.concat(F.lit("https://www.reddit.com/r/"), subsource, F.lit("/comments/"),
                       id_, F.lit("/")))
        .when(source == "reddit",
              F.concat(F.lit("https://www.reddit.com/comments/"), id_, F.lit("/")))
        .when(source == "feed", F.lit("")))


def comments_url_of_id(sid: Column) -> Column:
    """Comment link of a textual scrape id; ``<invalid>`` when it cannot be read."""
    p = parse_scrape_id(sid)
    return F.coalesce(comments_url(p["source"], p["subsource"], p["id"]), F.lit("<invalid>"))


def id_from_comments_url(source: Column, url: Column) -> Column:
    """Inverse of :func:`comments_url` as struct(source, subsource, id), else null."""
    trimmed = F.regexp_replace(url, "/+$", "")

    def tail(prefix: str, text: Column) -> Column:
        return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30))

    sub_re = r"^https://www\.reddit\.com/r/([^/]*)/[^/]*/(.*)$"
    by_sub = trimmed.rlike(sub_re)
    direct = tail("https://www.reddit.com/comments/", trimmed)
    found = (
        F.when(source == "hacker_news", tail("https://news.ycombinator.com/item?id=", url))
        .when(source == "slashdot", tail("https://tech.slashdot.org/story/", trimmed))
        .when(source == "lobsters", tail("https://lobste.rs/s/", trimmed))
        .when(source == "reddit",
              F.coalesce(direct, F.when(by_sub, F.regexp_extract(trimmed, sub_re, 2)))))
    sub = F.when((source == "reddit") & direct.isNull() & by_sub,
                 F.regexp_extract(trimmed, sub_re, 1))
    return F.when(found.isNotNull(), F.struct(
        source.alias("source"), sub.alias("subsource"), found.alias("id")))


def is_self_post(source: Column, id_: Column, host: Column, url: Column) -> Column:
    """The link points at the source's own comment page for this very post."""
    on_comments = F.lit(False)
    for name, suffix in COMMENT_HOSTS.items():
        on_comments = on_comments | ((source == name) & host.endswith(suffix))
    return F.coalesce(on_comments & url.contains(id_), F.lit(False))
