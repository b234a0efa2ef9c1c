"""Headline timings. Prints one JSON line.

Every step is timed once, into a sink that consumes all rows; story tables are built once
and then read from Parquet, as a service would read them.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    from linkloom.session import BUILD_SETTINGS, configure
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config(map=BUILD_SETTINGS).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def main() -> None:
    import checks
    from checks.registry import CFG
    from linkloom.operators import cluster, core, counts, search
    from linkloom.plans import merge as mg
    from linkloom.plans import stories as st
    from linkloom.plans.front_page import front_page
    from linkloom.sources.derived import sightings

    spark = session()
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    times: dict[str, float] = {}

    def timed(name: str, job) -> None:
        started = time.time()
        job()
        times[name] = round(time.time() - started, 3)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def table(name: str):
        return spark.read.parquet(f"{folder}/{name}")

    def save(df, name: str) -> None:
        df.repartitionByRange("shard").write.partitionBy("shard").parquet(f"{folder}/{name}")

    drain(sightings(spark, SF_DIR).limit(10))  # start the JVM's code paths
    timed("scrapes", lambda: sightings(spark, SF_DIR).write.parquet(f"{folder}/scrapes"))
    scrapes = table("scrapes")
    timed("clusters", lambda: drain(cluster.assign_clusters(core.core_rows(scrapes, CFG), CFG)))
    timed("stories", lambda: save(st.build_stories(scrapes, CFG), "stories"))
    timed("links", lambda: save(st.story_links(scrapes, CFG), "links"))
    stories, links = table("stories"), table("links")
    now = stories.agg(F.max("date")).first()[0]
    now = F.lit(now)
    timed("front_page", lambda: drain(front_page(stories, CFG, stored=True)))
    timed("search_tag", lambda: drain(search.run(stories, "tag", "ringtag", "ring", now, CFG)))
    timed("search_text", lambda: drain(search.run(stories, "text", "small gizmo", None, now, CFG)))
    timed("search_domain", lambda: drain(search.run(stories, "domain", "example.net", None, now, CFG)))
    timed("trend", lambda: drain(counts.trend(
        search.matches(stories, "tag", "ringtag", "ring"), stories)))
    late = F.col("source").isin("reddit", "feed")
    old, new = scrapes.where(~late), scrapes.where(late)
    save(st.build_stories(old, CFG), "old_stories")
    heads = mg.collections_of(new, CFG).groupBy("new_key", "url_norm").agg(
        F.min("date").alias("date"))
    from linkloom.operators.joins import match_existing
    timed("interval_match", lambda: drain(match_existing(heads, table("old_stories"))))
    from linkloom.plans.store import StoryStore
    store = StoryStore(spark, f"{folder}/store", CFG)
    timed("load", lambda: store.load(old))
    last = new.agg(F.max("shard")).first()[0]
    timed("ingest", lambda: store.ingest(new.where(F.col("shard") == last)))
    best = store.stories.orderBy(F.desc("shard"), F.desc("score")).limit(300).select("story_id")
    timed("reindex", lambda: store.reindex(best))
    for name in ("counts_by_month", "title_tagging", "parse_reddit", "parse_hn", "rate_limits",
                 "event_windows", "feed_text"):
        timed(name, lambda name=name: drain(checks.QUERIES[name](spark, SF_DIR)))

    n_scrapes, n_stories = scrapes.count(), stories.count()
    print(json.dumps({
        "metric": "story engine, total of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "rows": {"scrapes": n_scrapes, "stories": n_stories},
        "rows_per_sec": {
            "clusters": round(n_scrapes / times["clusters"]),
            "stories": round(n_scrapes / times["stories"]),
            "front_page": round(n_stories / times["front_page"]),
            "search_text": round(n_stories / times["search_text"])}}))
    spark.stop()


if __name__ == "__main__":
    main()
