"""Clustering, merging, scoring and search on small fixtures."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import hn, lobsters, reddit, scrapes, slashdot
from linkloom.config import EngineConfig, TagConfig
from linkloom.operators import cluster, core, ranking, scoring, search, upsert
from linkloom.plans import merge as mg
from linkloom.plans import stories as st
from test_tagging import TAGS

CFG = EngineConfig(tags=TagConfig({**TAGS.tags, "c++": {"internal": "cplusplus", "symbol": True}}))


@pytest.mark.parametrize("days", [("2020-01-01", "2020-01-01"), ("2019-12-31", "2020-01-01")])
@pytest.mark.parametrize("unique", [True, False])
def test_same_url_is_one_story(spark, days, unique):
    rows = scrapes(spark, [hn("1", "http://example.com", "I love Rust", days[0]),
                           reddit("1", "rust", "http://example.com", "I love rust", days[1])])
    story, = st.build_stories(rows, CFG, unique).collect()
    assert (story.title, story.tags, story.n_scrapes) == ("I love Rust", ["rust"], 2)
    assert story.sources == {"hacker_news": "hacker_news-1", "reddit": "reddit-rust-1"}
    assert st.story_links(rows, CFG).count() == 2


def test_source_tags(spark):
    rows = scrapes(spark, [lobsters("1", "http://e.com", "Type inference and bread", "2020-01-01",
                                    ["plt", "c++", "person"])])
    assert st.build_stories(rows, CFG).first().tags == ["bread", "cplusplus", "plt"]


def slow_clusters(rows):
    """One row at a time: join the open story of the URL or start the next."""
    out, open_ = {}, {}
    for url, month in sorted({(r[0], r[1]) for r in rows}):
        if url not in open_ or month - open_[url] > 2:
            open_[url] = month
        out[url, month] = open_[url]
    return out


def test_clusters_with_a_hot_url(spark):
    rnd = random.Random(5)
    rows, want = [], []
    for i in range(600):
        url = "http://hot.com/x" if i % 3 == 0 else f"http://s{rnd.randrange(40)}.com"
        day = datetime(2015, 1, 1) + timedelta(days=rnd.randrange(1500))
        rows.append(hn(str(i), url, f"t{i}", day.isoformat()))
        want.append((url.split("//")[1], day.year * 12 + day.month - 1, str(i)))
    base = core.core_rows(scrapes(spark, rows), CFG)
    got = {(r.url_norm, r.shard): r.anchor for r in cluster.assign_clusters(base, CFG)
           .select("url_norm", "shard", "anchor").distinct().collect()}
    assert got == slow_clusters(want)
    one = st.build_stories(scrapes(spark, rows), CFG).select("story_id", "n_scrapes", "title", "score")
    two = st.build_stories(scrapes(spark, rows), CFG, unique_ids=False).select(*one.columns)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_copies_inside_a_story_count_once(spark):
    rows = scrapes(spark, [hn("1", "http://e.com", "old", "2020-01-01"),
                           hn("1", "http://e.com", "new", "2020-02-01")])
    story, = st.build_stories(rows, CFG, unique_ids=False).collect()
    assert (story.n_scrapes, story.title) == (1, "new")
    kept, = st.build_stories(rows, CFG.but(merge_policy="first"), unique_ids=False).collect()
    assert kept.title == "old"


def test_max_policy(spark):
    rows = scrapes(spark, [hn("1", "http://e.com", "a", "2020-01-01", points=9, comments=1),
                           hn("1", "http://e.com", "b", "2020-01-01", points=2, comments=5)])
    row, = cluster.dedup(rows, ["shard", "scrape_id"], "max").collect()
    assert (row.points, row.comments, row.raw_title) == (9, 5, "b")


def test_upsert_keeps_the_batch(spark):
    old = scrapes(spark, [hn("1", "http://e.com", "old", "2020-01-01"),
                          hn("2", "http://f.com", "kept", "2020-01-02")])
    new = scrapes(spark, [hn("1", "http://e.com", "mid", "2020-01-01"),
                          hn("1", "http://e.com", "new", "2020-01-01")])
    got = {r.scrape_id: r.raw_title for r in upsert.upsert_scrapes(old, new).collect()}
    assert got == {"hacker_news-1": "new", "hacker_news-2": "kept"}


def fold(spark, stored, batch):
    """Stories after merging ``batch`` into the stories of ``stored``."""
    old, new = scrapes(spark, stored), scrapes(spark, batch)
    stories = st.build_stories(old, CFG)
    out = mg.merge_batch(new, stories, st.story_links(old, CFG), old, CFG)
    return upsert.replace_rows(stories, out.gone, out.changed, "story_id"), out


def test_earlier_scrape_moves_the_story(spark):
    final, out = fold(spark, [hn("1", "http://e.com", "I love Rust", "2020-02-01")],
                      [reddit("9", "rust", "http://e.com", "x", "2020-01-20")])
    # February's story is not in January or December, so January opens its own story.
    assert [r.result for r in out.results.collect()] == ["new"]
    final, out = fold(spark, [hn("1", "http://e.com", "I love Rust", "2020-02-10")],
                      [reddit("9", "rust", "http://e.com", "x", "2020-02-01")])
    story, = final.collect()
    assert (story.n_scrapes, story.date) == (2, datetime(2020, 2, 1))
    assert [r.result for r in out.results.collect()] == ["merged"]


def test_month_edge_and_repeat(spark):
    urls = [hn(str(i), f"http://e{i}.com", "t", "2019-12-31") for i in range(30)]
    more = [reddit(str(i), "rust", f"http://e{i}.com", "t", "2020-01-01") for i in range(30)]
    final, _ = fold(spark, urls, more)
    assert final.count() == 30 and {r.n_scrapes for r in final.collect()} == {2}
    again, _ = fold(spark, urls, urls + more)
    assert again.count() == 30 and {r.n_scrapes for r in again.collect()} == {2}


def test_date_window(spark):
    base = datetime(2020, 6, 15)
    new = spark.createDataFrame(
        [(str(d), "n.com", base + timedelta(days=d)) for d in (-31, -30, -29, 0, 29, 30, 31)],
        "new_key STRING, url_norm STRING, date TIMESTAMP")
    old = spark.createDataFrame([("s", 2020 * 12 + 5, "n.com", base)],
                                "story_id STRING, shard INT, url_norm STRING, date TIMESTAMP")
    from linkloom.operators.joins import match_existing
    got = {r.new_key: r.match_id for r in match_existing(new, old).collect()}
    # Only June and July look into June; 30 days after is still inside, 31 is not.
    assert got == {"-31": None, "-30": None, "-29": None, "0": "s", "29": "s", "30": "s", "31": None}


def test_age_score_falls(spark):
    rows = spark.range(1440).select(scoring.age_score(F.col("id").cast("double")).alias("s"), "id")
    values = [r.s for r in rows.orderBy("id").collect()]
    assert all(a > b for a, b in zip(values, values[1:])) and values[24] == -120.0


def test_score_terms(spark):
    rows = scrapes(spark, [
        reddit("1", "x", "http://old.reddit.com/r/x/comments/1", "t" * 140, "2020-01-01",
               upvote_ratio=0.5, upvotes=5, comments=3, position=0),
        hn("2", "http://imgur.com/a", "t", "2020-01-01", comments=101, position=11),
        slashdot("3", "http://e.com", "t", "2020-01-01", comments=101)])
    base = core.core_rows(rows, CFG)
    got = defaultdict(dict)
    for r in scoring.scrape_term_rows(base, CFG.score, ["scrape_id"]).collect():
        got[r.scrape_id][r.reason] = r.value
    assert got["reddit-x-1"] == {"SelfLink": -20, "LongRedditTitle": -5, "PoorUpvoteRatio": -20,
                                 "UpvoteCount": -20, "CommentCount": -5}
    assert got["hacker_news-2"] == {"Position": 24.0, "ImageLink": -5, "CommentCount": 5}
    assert got["slashdot-3"] == {"Source": 5, "CommentCount": 5}
    assert {r.scrape_id: r.self_post for r in base.collect()}["reddit-x-1"]


def test_top_k(spark):
    """Of equal scores the earlier row stays."""
    scores = [5, 1, 7, 7, 3, 7, -2, 5]
    rows = spark.createDataFrame(list(enumerate(map(float, scores))), "seq INT, s DOUBLE")
    assert [r.seq for r in ranking.top_k(rows, "s", "seq", 5).collect()] == [2, 3, 5, 0, 7]


# A story and the terms that must find it: title words, tags under any name, hosts and parts of them.
STORIES = [
    ("http://bakery.test", "Cooling a loaf", ["loaf", "COOLING", "bakery.test"]),
    ("http://oven-works.test", "Cooling a loaf", ["oven-works.test", "http://oven-works.test"]),
    ("http://shop.mill.co.test", "Milling by night", ["milling", "mill.co.test", "co.test", "shop.mill.co.test"]),
    ("http://www.salt.test", "Salt&Co raises its prices", ["salt&co", "saltandco", "salt.test"]),
    ("http://kitchen.test", "Pressure-cookers again", ["pressure-cooker", "cookers"]),
    ("http://localhost", "One machine", ["http://localhost", "localhost."]),
]


@pytest.mark.parametrize("url,title,terms", STORIES)
def test_every_term_finds_the_story(spark, url, title, terms):
    tags = TagConfig({"salt&co": {"internal": "saltandco", "symbol": True}, "pressure-cooker": {"alt": "pressure(-)cooker(s)"}})
    cfg = CFG.but(tags=tags)
    stories = st.build_stories(scrapes(spark, [
        hn("1", url, title, "2020-01-01"),
        hn("2", "http://other.org/q", "Nothing of the kind", "2020-01-02")]), cfg)
    log = spark.createDataFrame([(t,) for t in terms], "search STRING")
    for q in search.classify(log, tags).collect():
        hits = search.run(stories, q.kind, q.text, q.alt, stories.agg(F.max("date")).scalar(), cfg)
        assert [r.title for r in hits.collect()] == [title], q
        assert [r.title for r in search.matches(stories, q.kind, q.text, q.alt).collect()] == [title], q


def test_symbol_tags_are_whole_entries(spark):
    rows = [("a", "x", ["c++"]), ("b", "about c", []), ("c", "the raspberry pi", []), ("d", "pi and raspberry", ["Raspberry-Pi"])]
    stories = spark.createDataFrame([(1, i, t, g) for i, t, g in rows], "shard INT, story_id STRING, title STRING, tags ARRAY<STRING>")
    found = lambda tag, alt=None: sorted(r.story_id for r in search.matches(stories, "tag", tag, alt).collect())
    assert found("c++") == ["a"] and found("cplusplus", "c++") == ["a"]
    assert found("raspberry-pi") == ["c", "d"] and found("x" * 60) == []


def test_long_tokens_are_found(spark):
    long = "pneumono" * 9
    stories = spark.createDataFrame([(1, "a", f"The {long} case", [])], "shard INT, story_id STRING, title STRING, tags ARRAY<STRING>")
    assert search.matches(stories, "text", long).count() == 1


def test_queries_of_every_shape_are_classified(spark):
    """Random strings of words, dots, slashes and blanks."""
    import random
    rng = random.Random(12)
    odd = ["".join(rng.choice(["ab", "7", ".", "/", ":", " ", "?", "http://", "é", "-"]) for _ in range(rng.randint(0, 6)))
           for _ in range(400)]
    rows = search.classify(spark.createDataFrame([(o,) for o in odd], "search STRING"), TAGS).collect()
    assert len(rows) == len(odd) and all(r.kind in ("", "tag", "url", "domain", "text") for r in rows)
    assert all((r.kind == "") == (not any(ch.isalnum() for ch in r.search)) for r in rows)
    own = search.classify(spark.createDataFrame([("blog",), (None,)], "search STRING"), TAGS,
                          own_phrase="blog", own_host="example.org").collect()
    assert [(r.kind, r.text) for r in own] == [("domain", "example.org"), ("", "")]


def test_pin(spark):
    rows = [hn(str(i), f"http://e{i}.com", "t", f"2020-01-0{i + 1}") for i in range(5)]
    stories = st.build_stories(scrapes(spark, rows), CFG)
    front = ranking.front_page_candidates(stories, 10)
    hot = ranking.hot_set(front, CFG, "http://e0.com").orderBy("position").collect()
    assert hot[0].url == "http://e0.com" and hot[0].pinned and len(hot) == 5
    plain = ranking.hot_set(front, CFG).orderBy("position").collect()
    assert plain[0].url == "http://e4.com"


def test_a_search_takes_titles_apart_once_however_many_terms(spark):
    """The filter on hits must not repeat the work on titles and tags for each term."""
    stories = spark.createDataFrame(
        [(24000, "s1", "http://a.org/x", "a.org", "one two three four", datetime(2000, 1, 2), 1.0, ["web", "Go"]),
         (24000, "s2", "http://b.org/x", "b.org", "unrelated", datetime(2000, 1, 3), 1.0, ["java"])],
        "shard INT, story_id STRING, url STRING, host STRING, title STRING, date TIMESTAMP, score DOUBLE, tags ARRAY<STRING>")

    def plan(words):
        found = search.related(stories, " ".join(words), ["web"], max_count=5)
        return found, found._jdf.queryExecution().optimizedPlan().toString()
    few, many = plan(["one", "two"]), plan(["one", "two", *[f"w{i}" for i in range(20)]])
    assert few[1].count("split(lower(title") == many[1].count("split(lower(title")
    assert [r.story_id for r in many[0].collect()] == ["s1"]
