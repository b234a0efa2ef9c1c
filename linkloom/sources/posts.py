"""The site's own posts: front-matter text files as feed scrapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids, text
from ..functions.months import month_of


def read_post_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, contents) of every ``*.md`` file; the name is the file's date."""
    files = spark.read.text(f"{folder}/*.md", wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)\.md$", 1)
    return files.select(name.alias("name"), F.col("value").alias("contents"))


def posts(files: DataFrame, site: str, extra_tags: tuple[str, ...] = ("blog",)) -> DataFrame:
    """id, title, url, slug, date, tags and contents; rows without a title line, a tags
    line or a date name are dropped. ``extra_tags`` are added to every post."""
    lines = F.split("contents", "\n")

    def front(key: str) -> F.Column:
        found = F.filter(lines, lambda line: line.startswith(f"{key}:"))
        return F.trim(F.regexp_replace(F.get(found, F.lit(0)), f"^({key}:)+", ""))

    staged = files.select(
        F.col("name").alias("id"), front("title").alias("title"), front("tags").alias("_tags"),
        dates.parse_rfc3339_loose(F.concat("name", F.lit("T00:00:00Z"))).alias("date"), "contents")
    slug = text.slug(F.col("title"))
    return (staged.where(F.col("title").isNotNull() & F.col("_tags").isNotNull()
                         & F.col("date").isNotNull())
            .select("id", "title",
                    F.concat(F.lit(f"https://{site}/blog/"), "id", F.lit("/"), slug).alias("url"),
                    slug.alias("slug"), "date",
                    F.concat(F.transform(F.split("_tags", ","), lambda t: F.trim(t)),
                             F.array(*[F.lit(t) for t in extra_tags])).alias("tags"),
                    "contents"))


def as_scrapes(rows: DataFrame) -> DataFrame:
    """Feed scrapes; the scrape id is the post's epoch second."""
    sid = F.unix_seconds("date").cast("string")
    none = F.lit(None)
    return rows.select(
        month_of(F.col("date")).alias("shard"),
        ids.scrape_id(F.lit("feed"), none.cast("string"), sid).alias("scrape_id"),
        F.lit("feed").alias("source"), none.cast("string").alias("subsource"), sid.alias("id"),
        "url", F.col("title").alias("raw_title"), "date",
        *[none.cast("bigint").alias(c) for c in (
            "position", "points", "comments", "score", "upvotes", "downvotes")],
        none.cast("float").alias("upvote_ratio"), none.cast("string").alias("flair"), "tags")
