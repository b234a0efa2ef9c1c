"""Link sightings derived from the driver's star-schema tables.

Each order is one sighting of a page: the order number picks the page and the title words,
its priority picks the source site, its customer the subreddit. Row counts follow the
tables, so every operator downstream grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import scrape_id
from ..functions.months import month_of
from ..functions.text import unescape_entities

SUBREDDIT_CYCLE = ("programming", "compilers", "rust", "science", "python", "technology")
TAG_CYCLE = ("person", "Programming", "java", "practices", "c++", "games", "Web", "go")
FLAIR_CYCLE = ("Biology", "Computer Science", "", "Health")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (index % len(values) + 1).cast("int"))


def sightings(spark: SparkSession, sf_dir: str, raw_text: bool = False) -> DataFrame:
    """The scrapes table. ``raw_text=True`` keeps entities in titles undecoded."""
    orders = table(spark, sf_dir, "orders").withColumn(
        "o_orderdate", F.col("o_orderdate").cast("timestamp"))
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("page_title"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    n_parts = parts.agg(F.count(F.lit(1))).scalar()

    k = F.col("o_orderkey")
    source = (F.when(F.col("o_orderpriority") == "1-URGENT", "hacker_news")
              .when(F.col("o_orderpriority") == "2-HIGH", "lobsters")
              .when(F.col("o_orderpriority") == "3-MEDIUM", "reddit")
              .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "slashdot")
              .otherwise("feed"))
    keyed = (orders
             .withColumn("page_key", k % n_pages)
             .withColumn("part_key", k % n_parts)
             .withColumn("source", source))
    joined = (keyed
              .join(pages, F.col("page_key") == F.col("page_id"))
              .join(parts, F.col("part_key") == F.col("p_partkey")))

    words = F.concat_ws(" ", F.col("page_title"), F.col("p_name"))
    lead = (F.when(k % 7 == 0, "Show HN: ").when(k % 7 == 1, "Ask HN: ")
            .when(k % 7 == 2, "[note] ").otherwise(""))
    trail = F.when(k % 11 == 0, " [pdf]").when(k % 11 == 1, " [video]").otherwise("")
    title = F.concat(lead, words, trail)
    volume = F.floor(F.col("o_totalprice")).cast("bigint")
    talk = (F.col("o_custkey") % 200).cast("bigint")
    is_reddit = F.col("source") == "reddit"
    joined = joined.withColumn("raw_title", title)
    out = joined.select(
        month_of(F.col("o_orderdate")).alias("shard"),
        "source",
        F.when(is_reddit, _pick(SUBREDDIT_CYCLE, F.col("o_custkey"))).alias("subsource"),
        k.cast("string").alias("id"),
        "url",
        (F.col("raw_title") if raw_text
         else unescape_entities(F.col("raw_title"))).alias("raw_title"),
        F.col("o_orderdate").alias("date"),
        F.when(F.col("source").isin("hacker_news", "reddit", "lobsters"),
               (k % 40).cast("bigint")).alias("position"),
        F.when(F.col("source") == "hacker_news", (volume % 200).cast("bigint")).alias("points"),
        F.when(F.col("source") != "feed", talk).alias("comments"),
        F.when(F.col("source").isin("reddit", "lobsters"),
               (volume % 300).cast("bigint")).alias("score"),
        F.when(is_reddit, (volume % 20).cast("bigint")).alias("upvotes"),
        F.when(is_reddit, (volume % 3).cast("bigint")).alias("downvotes"),
        F.when(is_reddit, ((volume % 4) * 0.25).cast("float")).alias("upvote_ratio"),
        F.when(is_reddit, _pick(FLAIR_CYCLE, F.col("o_custkey"))).alias("flair"),
        F.when(F.col("source").isin("lobsters", "slashdot", "feed"),
               F.array_distinct(F.array(_pick(TAG_CYCLE, k), _pick(TAG_CYCLE, F.col("o_custkey")))))
        .alias("tags"),
        k.alias("seq"))
    return out.withColumn(
        "scrape_id", scrape_id(F.col("source"), F.col("subsource"), F.col("id")))
