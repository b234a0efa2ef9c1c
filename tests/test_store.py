"""The stored tables, the streams, and rate limits."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import hn, reddit, scrapes
from linkloom.config import EngineConfig, RateLimit
from linkloom.operators import counts, figures, joins, quality, rates, search
from linkloom.plans import feeds
from linkloom.plans import stories as st
from linkloom.plans import store as store_module
from linkloom.plans.store import StoryStore
from linkloom.sources import backup
from linkloom.streaming import ingest as stream_ingest
from linkloom.streaming import late
from linkloom.streaming.rates import classify_stream
from test_tagging import TAGS

CFG = EngineConfig(tags=TAGS)


def links_agree(store):
    v = store.validate().collect()
    assert all(not r[n] for r in v for n in r.__fields__ if n not in ("shard", "stories"))
    assert store.links.count() == store.stories.agg(F.sum("n_scrapes")).first()[0]


def test_ingest_merge_and_move(spark, tmp_path):
    store = StoryStore(spark, str(tmp_path / "s"), CFG)
    first = [hn(str(i), f"http://e{i}.com/", f"t{i}", "2020-02-20") for i in range(6)]
    store.load(scrapes(spark, first))
    assert store.stories.count() == 6
    links_agree(store)
    again = store.ingest(scrapes(spark, first)).first()
    assert (again.merged, again.new) == (6, 0) and store.stories.count() == 6
    # An earlier sighting in the same month moves the story's date and id.
    moved = store.ingest(scrapes(spark, [
        reddit("9", "rust", "https://www.e0.com", "r", "2020-02-01"),
        reddit("8", "rust", "http://new.com", "r", "2020-03-01"),
        reddit("7", "rust", "http://e1.com", "r", "2020-03-05")])).first()
    assert (moved.merged, moved.new) == (2, 1)
    assert store.stories.count() == 7
    links_agree(store)
    e0 = store.stories.where("url_norm = 'e0.com'").first()
    assert (e0.n_scrapes, e0.date) == (2, datetime(2020, 2, 1))
    ids = store.stories.select("story_id").unionByName(spark.createDataFrame([("x",)], "story_id STRING"))
    re = store.reindex(ids).first()
    assert (re.merged, re.not_found) == (7, 1) and store.stories.count() == 7
    links_agree(store)
    hot = store.refresh_hot_set()
    assert hot.count() == 7
    plan = store.front_page()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "dynamicpruning" in plan or "Subquery" in plan


def test_commit_is_replayed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    store = StoryStore(spark, root, CFG)
    store.load(scrapes(spark, [hn("1", "http://e.com", "t", "2020-02-20")]))
    monkeypatch.setattr(StoryStore, "_apply", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        store.ingest(scrapes(spark, [hn("2", "http://e.com", "u", "2020-02-21")]))
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert store.stories.first().n_scrapes == 1
    again = StoryStore(spark, root, CFG)
    assert again.stories.first().n_scrapes == 2
    links_agree(again)


def test_backup_of_changed_months(spark, tmp_path):
    store = StoryStore(spark, str(tmp_path / "s"), CFG)
    store.load(scrapes(spark, [hn("1", "http://e.com", "t", "2020-02-20"),
                               hn("2", "http://f.com", "t", "2020-03-20")]))
    out = str(tmp_path / "b")
    assert [r.result for r in store.backup(out).collect()] == ["success", "success"]
    assert [r.result for r in store.backup(out).collect()] == ["no_change", "no_change"]
    store.ingest(scrapes(spark, [hn("3", "http://g.com", "t", "2020-03-21")]))
    assert [r.result for r in store.backup(out).collect()] == ["no_change", "success"]
    # A changed title, with equal dates and as many rows.
    store.ingest(scrapes(spark, [hn("1", "http://e.com", "another", "2020-02-20")]))
    assert [r.result for r in store.backup(out).collect()] == ["success", "no_change"]
    store.ingest(scrapes(spark, [hn("9", "http://h.com", "t", "2020-05-20")]))
    assert [r.result for r in store.backup(out).collect()] == ["no_change", "no_change", "empty", "success"]
    store.ingest(scrapes(spark, [hn("10", "http://i.com", "t", "2020-05-20")]))
    assert backup.read_backup(spark, out + "/data").count() == 4


def test_load_keeps_an_id_once(spark, tmp_path):
    """One id seen in two months: stories and links name the same story."""
    store = StoryStore(spark, str(tmp_path / "s"), CFG)
    store.load(scrapes(spark, [hn("1", "http://e.com", "t", "2020-01-31"), hn("1", "http://e.com", "t", "2020-02-01"),
                               hn("2", "http://e.com", "t", "2020-02-01")]))
    assert store.scrapes.count() == 2
    links_agree(store)
    row, = store.validate().collect()
    assert row.stories == 1 and not any(row[n] for n in row.__fields__ if n not in ("shard", "stories"))


def test_validation_sees_both_directions(spark, tmp_path):
    store = StoryStore(spark, str(tmp_path / "s"), CFG)
    store.load(scrapes(spark, [hn(str(i), f"http://e{i % 3}.com", "t", f"2020-02-0{i + 1}") for i in range(6)]))
    ids_ = sorted(r.story_id for r in store.stories.collect())
    lost = quality.validate(store.stories.where(F.col("story_id") != ids_[0]),
                            store.links.where(F.col("story_id") != ids_[1]), store.scrapes).first()
    assert (lost.orphan_links, lost.unlinked_stories, lost.wrong_counts, lost.dangling_links) == (2, 1, 0, 0)
    only_links = quality.validate(store.stories.limit(0), store.links, store.scrapes).first()
    assert (only_links.stories, only_links.orphan_links) == (0, 6)


def scans(plans, table):
    """The partition filters of every scan of a stored table."""
    return [line for p in plans for line in p.splitlines() if "FileScan" in line and f"/{table}]" in line]


def test_merging_reads_only_near_months(spark, tmp_path, monkeypatch):
    store = StoryStore(spark, str(tmp_path / "s"), CFG)
    store.load(scrapes(spark, [hn(str(i), f"http://e{i}.com", "t", f"20{10 + i}-03-05") for i in range(8)]))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # whole paths in plans
    plans = []
    write = type(store)._write

    def noted(self, df, name, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name, path)
    monkeypatch.setattr(type(store), "_write", noted)
    seen = []
    merge_batch = store_module.merge.merge_batch

    def watched(batch, stories, links, raw, cfg, stage):
        def noted_stage(df, name):
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return stage(df, name)
        return merge_batch(batch, stories, links, raw, cfg, noted_stage)
    monkeypatch.setattr(store_module.merge, "merge_batch", watched)
    store.ingest(scrapes(spark, [hn("n", "http://e5.com", "u", "2015-03-09")]))
    store.reindex(store.stories.where("url = 'http://e3.com'").select("story_id"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for name in ("scrapes", "stories", "links"):
        lines = scans(plans + seen, name)
        assert lines and all("PartitionFilters: []" not in line for line in lines), (name, lines)
    assert store.stories.where("n_scrapes = 2").count() == 1
    links_agree(store)


def test_a_hot_storys_links_lie_in_several_files(spark, tmp_path):
    store = StoryStore(spark, str(tmp_path / "s"), CFG)
    rows = [hn(str(i), "http://hot.com" if i % 3 == 0 else f"http://e{i % 50}.com", "t", "2020-02-0%d" % (1 + i % 9)) for i in range(3000)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are one partition
    try:
        store.load(scrapes(spark, rows))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    hot = store.stories.where("url = 'http://hot.com'").first().story_id
    files = store.links.where(F.col("story_id") == hot).select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) > 1 and sum(r["count"] for r in files) == 1000


def test_broken_backup_lines(spark, tmp_path):
    line = scrapes(spark, [hn("1", "http://e.com", "t", "2020-02-20")]).select(backup.to_record()).first()[0]
    for n, (content, good) in enumerate([
            (f"{line}\n{line}\n", 2), (f"{line}\n" + '{"HackerNews": {"id"', 1), (f"{line}\n{{oops\n{line}\n", None),
            (f"{line}\n{{oops}}\n", None), (f"{line}\n{{oops\n{line}\n" + '{"Hack', None), ("", 0)]):
        folder = tmp_path / str(n)
        folder.mkdir()
        (folder / "a.txt").write_text(content)
        (folder / "b.txt").write_text(f"{line}\n")
        if good is None:
            with pytest.raises(ValueError, match="a.txt"):
                backup.read_backup(spark, str(folder))
            assert backup.read_backup(spark, str(folder), strict=False).count() >= 2
        else:
            assert backup.read_backup(spark, str(folder)).count() == good + 1


def test_payload_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    kids = [{"kind": "t3", "data": {
        "id": f"p{i}", "subreddit": "rust", "created_utc": 1.7e9 + i, "url": f"http://e{i % 3}.com",
        "title": f"t{i}", "num_comments": 1, "score": 1, "downs": 0, "ups": 1, "upvote_ratio": 1.0}}
        for i in range(6)]
    for n in range(2):
        body = json.dumps({"data": {"children": kids[n * 3:n * 3 + 3]}})
        (folder / f"{n}.json").write_text(json.dumps(
            {"payload": n, "source": "reddit", "url": "u", "status": 200, "body": body}) + "\n")
    (folder / "z.json").write_text(json.dumps({"payload": 7, "source": "attic", "url": "u", "status": 200, "body": ""}) + "\n")
    store = StoryStore(spark, str(tmp_path / "s"), CFG)
    payloads = stream_ingest.payload_stream(spark, str(folder), files_per_batch=1)
    q = stream_ingest.ingest_stream(payloads, store, str(tmp_path / "cp"))
    q.awaitTermination(180)
    assert store.stories.count() == 3 and store.scrapes.count() == 6
    assert {r.n_scrapes for r in store.stories.collect()} == {2}
    assert store.hot_set.count() == 3
    assert {(r.payload, r.message) for r in store.warnings.collect()} == {(7, "No parser for source attic")}


def test_window_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"ts": f"2024-01-01T0{h}:10:00Z", "path": "/"} for h in (1, 1, 2, 5)]
    (folder / "a.json").write_text("\n".join(map(json.dumps, lines)))
    q = stream_ingest.page_window_stream(stream_ingest.event_stream(spark, str(folder)),
                                         str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [r.n for r in got] == [2, 1]


def slow_levels(events, limit):
    """All keys event by event, with explicit bucket maps."""
    taken = {}
    out = {}
    for key, ts, eid in sorted(events, key=lambda e: (e[1], e[2])):
        level = "none"
        for size, soft, hard in ((limit.short_seconds, limit.short_soft, limit.short_hard),
                                 (limit.long_seconds, limit.long_soft, limit.long_hard)):
            b = int((ts - datetime(1970, 1, 1)).total_seconds()) // size
            seen = taken.get((key, size, b), 0) + taken.get((key, size, b - 1), 0)
            if seen >= 2 * hard:
                level = "hard"
                break
            taken[key, size, b] = taken.get((key, size, b), 0) + 1
            if seen >= 2 * soft:
                level = "soft"
        out[eid] = level
    return out


def random_events(n=3000):
    rnd = random.Random(3)
    start = datetime(2024, 1, 1)
    # One key holds a third of all events.
    return [("hot" if i % 3 == 0 else f"k{rnd.randrange(8)}",
             start + timedelta(seconds=rnd.randrange(5400)), i) for i in range(n)]


LIMIT = RateLimit(short_soft=4, long_soft=15)


def test_rates_match_the_slow_model(spark):
    events = random_events()
    df = spark.createDataFrame(events, "key STRING, ts TIMESTAMP, event_id BIGINT")
    want = slow_levels(events, LIMIT)
    got = {r.event_id: r.level for r in rates.classify_events(df, LIMIT).collect()}
    assert got == want and set(want.values()) == {"none", "soft", "hard"}
    sums = rates.rate_summary(df, LIMIT).agg(*[F.sum(c).alias(c) for c in rates.LEVELS]).first()
    assert sums.asDict() == {k: list(want.values()).count(k) for k in rates.LEVELS}


def test_rate_stream_matches_the_batch(spark, tmp_path):
    events = random_events(600)
    kind = "key STRING, ts TIMESTAMP, event_id BIGINT"
    df = spark.createDataFrame(events, kind)
    # Two batches, the second out of order; a third moves the watermark past all counters.
    early = df.where("ts < '2024-01-01 00:45:00'")
    early.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.subtract(early).orderBy(F.desc("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for day in (2, 3):
        spark.createDataFrame([("last", datetime(2024, 1, day), -1)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (classify_stream(stream, LIMIT).writeStream.format("parquet")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start())
    q.awaitTermination(180)
    seconds = spark.read.parquet(str(tmp_path / "out"))
    got = {r.event_id: r.level for r in rates.levels_of(df, seconds).collect()}
    assert got == slow_levels(events, LIMIT)
    # Keys whose buckets are over are gone from the state.
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) >= 9 and kept[-1] <= 3


def test_late_collections_wait_for_their_story(spark, tmp_path):
    rnd, start = random.Random(6), datetime(2024, 1, 15)
    new = [(f"n{i}", f"u{i % 40}", start + timedelta(days=rnd.randrange(60))) for i in range(200)]
    old = [(f"s{i}", f"u{i % 50}", start + timedelta(days=rnd.randrange(60))) for i in range(150)]
    news = spark.createDataFrame(new, "new_key STRING, url_norm STRING, date TIMESTAMP")
    olds = (spark.createDataFrame(old, "story_id STRING, url_norm STRING, date TIMESTAMP")
            .withColumn("shard", (F.year("date") * 12 + F.month("date") - 1).cast("int")).select("story_id", "shard", "url_norm", "date"))
    far = datetime(2024, 9, 1)
    for name, df, last in (("new", news, [("x", "x", far)]), ("old", olds, [("y", 1, "y", far)])):
        path = str(tmp_path / name)
        for turn in (1, 0):  # the later half arrives first
            part = df.where(F.pmod(F.xxhash64("url_norm", "date"), F.lit(2)) == turn)
            part.coalesce(1).write.mode("append").parquet(path)
        for _ in range(2):
            spark.createDataFrame(last, df.schema).coalesce(1).write.mode("append").parquet(path)
    read = {n: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n, df in (("new", news), ("old", olds))}
    q = (late.match_stream(read["new"], read["old"], 30, "90 days").writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(180)
    got = {tuple(r) for r in late.best_matches(spark.read.parquet(str(tmp_path / "out"))).where("new_key <> 'x'").collect()}
    assert got == {tuple(r) for r in joins.match_existing(news, olds).collect()}
    assert any(r[3] is None for r in got) and any(r[3] for r in got)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) >= 300 and kept[-1] <= 4


def test_limits_in_one_minute(spark):
    limit = RateLimit(short_soft=10, long_soft=10**6)
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", start + timedelta(milliseconds=i), i) for i in range(50)]
                               + [("b", start, 99)], "key STRING, ts TIMESTAMP, event_id BIGINT")
    got = [r.level for r in rates.classify_events(df, limit).orderBy("event_id").collect()]
    assert got == ["none"] * 20 + ["soft"] * 20 + ["hard"] * 10 + ["none"]


def test_feed_round_trip(spark):
    rows = scrapes(spark, [hn("1", "http://e.com", "A < B", "2020-01-01"),
                           reddit("2", "rust", "http://e.com", "x", "2020-01-02")])
    stories = st.build_stories(rows, CFG)
    ranked = feeds.per_key(stories, 10, feeds.newest_order())
    tags = spark.createDataFrame([("rust", 5), ("c++", 9)], "tag STRING, n BIGINT")
    doc = json.loads(feeds.json_feeds(ranked, tags, CFG).first().value)
    assert doc["v"] == 1 and doc["tags"] == ["c++", "rust"]
    assert doc["stories"][0]["reddit"] == "https://www.reddit.com/r/rust/comments/2/"
    assert "lobsters" not in doc["stories"][0]
    back = feeds.read_json_feeds(feeds.json_feeds(ranked, tags, CFG)).first()
    assert (back.hacker_news, back.reddit, back.lobsters) == ("hacker_news-1", "reddit-rust-2", None)
    atom = feeds.atom_feeds(ranked, F.lit("2020-01-03").cast("timestamp"), "http://s", "S", CFG)
    assert "<title>A &lt; B</title>" in atom.first().value


def test_trend_edges(spark):
    def run(hit_months, months):
        stories = spark.createDataFrame([(m,) for m in months for _ in range(2)], "shard INT")
        hits = spark.createDataFrame([(m,) for m in hit_months], "shard INT")
        return [r.ratio for r in counts.trend(hits, stories).orderBy("shard").collect()]
    assert run([], range(20)) == [0.0] * 12
    assert run([5], range(20)) == [0.0, 0.0, 0.5] + [0.0] * 14
    assert len(run([19], range(20))) == 12
    assert len(run([1], [0, 1, 2])) == 3


def test_validation_finds_faults(spark):
    rows = scrapes(spark, [hn("1", "http://e.com", "t", "2020-01-01")])
    stories, links = st.build_stories(rows, CFG), st.story_links(rows, CFG)
    bad = quality.validate(stories.unionByName(stories), links, rows.limit(0)).first()
    assert (bad.stories, bad.duplicate_ids, bad.dangling_links) == (2, 1, 1)


def test_bots_pass_both_limits(spark):
    bot_limit = RateLimit(short_soft=6, long_soft=20)
    events = [(k, "bot" if i % 2 else "browser", bool(i % 2), t, i)
              for k, t, i in random_events(1200)]
    df = spark.createDataFrame(
        events, "ip STRING, agent STRING, is_bot BOOLEAN, ts TIMESTAMP, event_id BIGINT")
    by_ip = slow_levels([(e[0], e[3], e[4]) for e in events], LIMIT)
    by_bot = slow_levels([(e[1], e[3], e[4]) for e in events
                          if e[2] and by_ip[e[4]] != "hard"], bot_limit)
    rank = {"none": 0, "soft": 1, "hard": 2}
    want = {i: max(by_ip[i], by_bot.get(i, "none"), key=rank.get) for i in by_ip}
    got = {r.event_id: r.level for r in rates.classify_requests(df, LIMIT, bot_limit).collect()}
    assert got == want and any(by_bot[i] == "hard" for i in by_bot)


def same_figures(spark, store):
    kept, fresh = store.figures.select(*figures.KEY, "n"), figures.month_figures(store.stories)
    assert spark.read.parquet(f"{store.root}/figures").count() == fresh.count()
    assert kept.exceptAll(fresh).count() == 0 and fresh.exceptAll(kept).count() == 0


def test_figures_follow_merges_and_searches_read_their_months(spark, tmp_path):
    store = StoryStore(spark, str(tmp_path / "s"), CFG)
    rows = [hn(str(i), f"http://e{i}.com/", f"rust on month{i} c++" if i % 2 else f"raspberry pi {i}", f"20{10 + i}-02-20") for i in range(8)]
    store.load(scrapes(spark, rows))
    same_figures(spark, store)
    store.ingest(scrapes(spark, [hn("20", "http://e1.com/", "Rust again, renamed", "2011-02-10"), hn("21", "http://z.com", "new", "2012-02-21"),
                                 reddit("5", "rust", "http://e3.com", "x", "2013-02-25")]))
    same_figures(spark, store)
    store.reindex(store.stories.select("story_id"))
    same_figures(spark, store)
    for kind, query, alt in (("text", "month3 again", None), ("text", "rust", None), ("tag", "c++", "cplusplus"), ("tag", "raspberry-pi", None),
                             ("domain", "e3.com", None), ("domain", "com", None), ("text", "nowhere", None)):
        now = F.lit("2020-01-01").cast("timestamp")
        want = [tuple(r) for r in search.run(store.stories, kind, query, alt, now, CFG).select("story_id", "relevance", "rank_score").collect()]
        assert [tuple(r) for r in store.search(kind, query, alt, now).select("story_id", "relevance", "rank_score").collect()] == want
    found = store.search("text", "month3", None, now)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and plan.count("FileScan") == 1 and f"shard#" in plan and "PartitionFilters: [isnotnull(shard" in plan
    few = EngineConfig(tags=TAGS, max_count=2)
    limited = search.run(store.stories, "text", "rust", None, now, few, store.figures)
    assert [r.story_id for r in limited.collect()] == [r.story_id for r in search.run(store.stories, "text", "rust", None, now, few).collect()]


def test_the_hot_set_is_never_missing(spark, tmp_path, monkeypatch):
    store = StoryStore(spark, str(tmp_path / "s"), CFG)
    store.load(scrapes(spark, [hn("1", "http://e.com", "t", "2020-02-20")]))
    assert store.hot_set.count() == 1  # before the first refresh
    store.refresh_hot_set()
    store.ingest(scrapes(spark, [hn("2", "http://f.com", "t", "2020-02-20")]))
    before, point = store.hot_set, store._point
    seen = []
    monkeypatch.setattr(store, "_point", lambda *a: (seen.append(store.hot_set.count()), point(*a))[1])
    assert store.refresh_hot_set().count() == 2 and seen == [1] and before.count() == 1
    store.refresh_hot_set()
    store.refresh_hot_set()
    assert len([x for x in (tmp_path / "s" / "hot_set").iterdir() if x.is_dir()]) == 2


def test_broken_files_and_rows_are_reported(spark, tmp_path):
    store = StoryStore(spark, str(tmp_path / "s"), CFG)
    store.load(scrapes(spark, [hn(str(i), f"http://e{i}.com", "t", f"2020-0{1 + i % 3}-20") for i in range(9)]))
    assert store.broken().count() == 0
    bad = scrapes(spark, [hn("99", "http://x.com", "t", "2020-01-21")]).select(*store.scrapes.columns).withColumn("date", F.lit(None).cast("timestamp"))
    bad.write.mode("append").partitionBy("shard").parquet(f"{store.root}/scrapes")
    month = next(x for x in sorted((tmp_path / "s" / "scrapes").iterdir()) if x.name.startswith("shard="))
    (month / "part-broken.parquet").write_bytes(b"PAR1 no table PAR1")
    got = [tuple(r) for r in store.broken().collect()]
    assert {(t, i, m) for t, _, i, m in got} == {("scrapes", "hacker_news-99", "missing date"), ("scrapes", None, "unreadable file")} and len(got) == 2
    assert all(f and "shard=" in f for _, f, _, _ in got)


def test_commit_moves_staged_files(spark, tmp_path, monkeypatch):
    """Staged files are not written again; a commit that ends between two moves is finished later."""
    def files(root):
        return {p.name for p in root.glob("*/shard=*/*.parquet")}

    rows = scrapes(spark, [hn(str(i), f"http://e{i}.com", "t", f"20{10 + i}-03-05") for i in range(3)])
    store, staged, apply = StoryStore(spark, str(tmp_path / "s"), CFG), set(), StoryStore._apply
    monkeypatch.setattr(StoryStore, "_apply", lambda self: (staged.update(files(tmp_path / "s/_staging/load")), apply(self)))
    store.load(rows)
    assert staged and files(tmp_path / "s") == staged
    moves, move = [], StoryStore._move

    def stop(self, *where):
        if len(moves) == 2:
            raise RuntimeError("lost")
        moves.append(where)
        move(self, *where)

    monkeypatch.setattr(StoryStore, "_move", stop)
    try:
        store.ingest(scrapes(spark, [hn("9", "http://e1.com", "u", "2011-03-09")]))
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert len(moves) == 2
    again = StoryStore(spark, str(tmp_path / "s"), CFG)
    assert again.stories.count() == 3 and again.scrapes.count() == 4 and again.links.count() == 4
    assert not (tmp_path / "s/_staging").exists()
    links_agree(again)
