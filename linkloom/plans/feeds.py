"""Feeds: JSON, Atom and text, for one result or for every tag and host at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SOURCES, EngineConfig, TagConfig
from ..functions import dates, ids
from ..operators import ranking

JSON_COUNT, ATOM_COUNT, TEXT_COUNT = 150, 30, 100

# Feed field -> source, a fixed format.
JSON_LINKS = {"reddit": "reddit", "hnews": "hacker_news", "lobsters": "lobsters",
              "slashdot": "slashdot"}

_STORY = """STRUCT<date: STRING, href: STRING, title: STRING, tags: ARRAY<STRING>,
            reddit: STRING, hnews: STRING, lobsters: STRING, slashdot: STRING>"""


def _source_link(source: str) -> Column:
    """Comment link of a story's scrape on a source; null when it has none."""
    sid = F.try_element_at("sources", F.lit(source))
    p = ids.parse_scrape_id(sid)
    return ids.comments_url(F.lit(source), p["subsource"], p["id"])


def per_key(stories: DataFrame, count: int, order: list[Column]) -> DataFrame:
    """The first ``count`` stories of every host and tag, with their ``rank`` from 0.

    ``rank < count`` sits directly on the window, so each task keeps at most ``count``
    rows per key before the shuffle, however many stories a hot key has.
    """
    keyed = stories.withColumn("key", F.explode(F.array_distinct(
        F.concat(F.array("host"), "tags"))))
    window = Window.partitionBy("key").orderBy(*order)
    return (keyed.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= count)
            .withColumn("rank", F.col("_n") - 1).drop("_n"))


def newest_order() -> list[Column]:
    return [F.desc("date"), F.asc("story_id")]


def json_story(cfg: TagConfig) -> Column:
    return F.struct(
        dates.to_rfc3339(F.col("date")).alias("date"), F.col("url").alias("href"),
        F.col("title"), ranking.display_tags(cfg).alias("tags"),
        *[_source_link(s).alias(f) for f, s in JSON_LINKS.items()])


def json_feeds(ranked: DataFrame, tags: DataFrame | None,
               cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(key, value): one JSON feed per key of ``per_key`` rows, absent links omitted.

    ``tags`` is the top-tag table (tag, n), at most 50 rows, the same in every feed.
    """
    rows = ranked.select("key", F.struct("rank", json_story(cfg.tags).alias("story")).alias("s"))
    feeds = rows.groupBy("key").agg(F.transform(
        F.sort_array(F.collect_list("s")), lambda s: s["story"]).alias("stories"))
    none = F.array().cast("array<string>")
    if tags is None:
        top = none
    else:
        top = tags.agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "tag")), False),
                                   lambda s: s["tag"])).scalar()
    return feeds.select("key", F.to_json(F.struct(
        F.lit(1).alias("v"), top.alias("tags"), "stories")).alias("value"))


def read_json_feeds(feeds: DataFrame) -> DataFrame:
    """Stories of JSON feeds with a scrape id per source; bad comment links give null."""
    doc = F.from_json("value", f"STRUCT<v: INT, tags: ARRAY<STRING>, stories: ARRAY<{_STORY}>>")
    rows = feeds.select("key", F.posexplode(doc["stories"]).alias("rank", "s"))
    back = []
    for field, source in JSON_LINKS.items():
        p = ids.id_from_comments_url(F.lit(source), F.col(f"s.{field}"))
        back.append(F.when(p.isNotNull(), ids.scrape_id(p["source"], p["subsource"], p["id"]))
                    .alias(source))
    return rows.select(
        "key", "rank", F.to_timestamp("s.date").alias("date"), F.col("s.href").alias("url"),
        F.col("s.title").alias("title"), F.col("s.tags").alias("tags"), *back)


def text_entry(cfg: TagConfig, now: Column) -> Column:
    shown = F.filter(ranking.display_tags(cfg), lambda t: ~t.contains("."))
    line = F.concat_ws(
        "\n", F.concat(F.lit("id: story-"), F.col("rank").cast("string")),
        F.concat(F.lit("date: "), dates.relative_time(F.col("date"), now)),
        F.concat(F.lit("title: "), "title"), F.concat(F.lit("url: "), "url"),
        F.concat(F.lit("domain: "), "host"),
        F.concat(F.lit("tags:"), F.array_join(F.transform(
            shown, lambda t: F.concat(F.lit(" "), t)), "")))
    return line


def _joined(ranked: DataFrame, entry: Column, between: str) -> DataFrame:
    rows = ranked.select("key", F.struct("rank", entry.alias("e")).alias("s"))
    return rows.groupBy("key").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list("s")), lambda s: s["e"]), between).alias("value"))


def text_feeds(ranked: DataFrame, now: Column, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    return _joined(ranked, text_entry(cfg.tags, now), "\n\n")


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                      ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def atom_entry(cfg: TagConfig, site: str) -> Column:
    """One Atom entry; its summary lists the comment links and the tags as HTML."""
    when, url = dates.to_rfc3339(F.col("date")), xml_escape(F.col("url"))
    links = F.array_join(F.array_compact(F.array(*[
        F.when(_source_link(s) != "", F.concat(
            F.lit('<p><a href="'), _source_link(s), F.lit(f'">{s.replace("_", " ")}</a></p>')))
        for s in SOURCES if s != "other"])), "")
    tags = F.array_join(F.transform(ranking.display_tags(cfg), lambda t: F.concat(
        F.lit(f'<a href="{site}/?search='), t, F.lit('">'), t, F.lit("</a>"))), " ")
    summary = xml_escape(F.concat(links, F.lit("<p>Tags: "), tags, F.lit("</p>")))
    return F.concat(
        F.lit("<entry><title>"), xml_escape(F.col("title")),
        F.lit('</title><link rel="alternate" href="'), url, F.lit('"/><id>'), url,
        F.lit("</id><author><name>"), F.col("host"), F.lit("</name></author><published>"), when,
        F.lit("</published><updated>"), when, F.lit('</updated><summary type="html">'), summary,
        F.lit("</summary></entry>"))


def atom_feeds(ranked: DataFrame, now: Column, site: str, name: str,
               cfg: EngineConfig = EngineConfig()) -> DataFrame:
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom">'
              f"<title>{name}</title><updated>"), dates.to_rfc3339(now),
        F.lit(f'</updated><id>{site}/</id><link rel="self" href="{site}/feed"/>'
              f'<link rel="alternate" href="{site}/"/>'))
    bodies = _joined(ranked, atom_entry(cfg.tags, site), "")
    return bodies.select("key", F.concat(head, "value", F.lit("</feed>")).alias("value"))


def write_feeds(feeds: DataFrame, path: str, buckets: int = 256) -> None:
    """(key, value) as Parquet in ``buckets`` folders by a hash of the key: as many folders
    whatever the number of hosts and tags. ``read_feed`` finds one of them again."""
    bucketed = feeds.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    bucketed.repartition("bucket", "key").sortWithinPartitions("key").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_feed(spark: SparkSession, path: str, key: str, buckets: int = 256) -> DataFrame:
    """The feed of one key: one folder is read."""
    bucket = F.pmod(F.xxhash64(F.lit(key)), F.lit(buckets)).cast("int")
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("key") == key)).select("key", "value")


def story_document(stories: DataFrame) -> DataFrame:
    """Raw document dump: (story_id, value) with every stored field."""
    return stories.select("story_id", F.to_json(F.struct("*")).alias("value"))
