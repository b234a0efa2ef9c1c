"""Hand-written payloads with good and broken records."""

import json
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from linkloom.config import SourceConfig
from linkloom.schema import PAYLOADS
from linkloom.sources import backup, crawl, payloads, posts


def frame(spark, *bodies, status=200):
    rows = [(i, s, f"http://{s}/{i}", status, b, None) for i, (s, b) in enumerate(bodies)]
    return spark.createDataFrame(rows, PAYLOADS)


def child(id_, sub="Rust", kind="t3", **kw):
    data = {"id": id_, "subreddit": sub, "stickied": False, "created_utc": 1700000000.0,
            "url": "https://e.com/?a=1&amp;b=2", "title": "A &amp; B", "num_comments": 3,
            "score": 4, "downs": 0, "ups": 5.9, "upvote_ratio": 0.5, "link_flair_text": None, **kw}
    return {"kind": kind, "data": {k: v for k, v in data.items() if v != "drop"}}


def test_reddit(spark):
    body = json.dumps({"data": {"children": [
        child("a"), child("b", stickied=True), child("c", title="drop"), child("d", sub="zig"),
        child("e", kind="t5"), child("f", ups=-1), child("g", score="12"), child("h", url="nope"),
        child("i", num_comments=2**40), child("drop"), child("j", link_flair_text="X &lt; Y")]}})
    out = payloads.parse_reddit(frame(spark, ("reddit", body), ("reddit", "{}"), ("reddit", "<html>")))
    rows = {r.id: r for r in out.scrapes.collect()}
    assert set(rows) == {"a", "d", "j"}
    # The broken c, f, g, h and i used up positions 2 to 6 of their subreddit.
    assert (rows["a"].position, rows["d"].position, rows["j"].position) == (1, 1, 7)
    assert (rows["a"].url, rows["a"].raw_title, rows["a"].subsource) == (
        "https://e.com/?a=1&b=2", "A & B", "rust")
    assert (rows["a"].upvotes, rows["a"].flair, rows["j"].flair) == (5, "", "X < Y")
    assert rows["a"].date == datetime(2023, 11, 14, 22, 13, 20)
    assert Counter(r.message for r in out.warnings.collect()) == {
        "Ignoring stickied story": 1, "Missing field title": 1, "Unknown story type": 1,
        "Bad integer ups": 1, "Bad integer score": 1, "Unmappable URL": 1,
        "Bad integer num comments": 1, "Missing field id": 1, "Missing children element": 2}


def test_lobsters(spark):
    def item(id_, extra=""):
        return (f"<item><title>T {id_} &amp; &#60;x&#62;</title><link>https://e.com/{id_}</link>"
                f'<guid isPermaLink="false">https://lobste.rs/s/{id_}</guid>'
                f"<author>x</author>{extra}<category>rust</category><category>web</category></item>")
    date = "<pubDate>Fri, 23 Dec 2022 13:04:48 -0600</pubDate>"
    body = ('<?xml version="1.0"?><rss version="2.0"><channel><title>L</title>'
            + item("a", date) + item("b") + item("c", date) + "</channel></rss>")
    one = '<rss><channel><item><title>x</title><guid>https://lobste.rs/s/q</guid>' \
          f"<link>https://e.com</link>{date}</item></channel></rss>"
    out = payloads.parse_lobsters(frame(spark, ("lobsters", body), ("lobsters", one), ("lobsters", "no")))
    rows = {r.id: r for r in out.scrapes.collect()}
    assert {k: r.position for k, r in rows.items()} == {"a": 1, "c": 3, "q": 1}
    assert rows["a"].raw_title == "T a & <x>" and rows["a"].tags == ["rust", "web"]
    assert rows["q"].tags == [] and rows["a"].date == datetime(2022, 12, 23, 19, 4, 48)
    assert sorted(r.message for r in out.warnings.collect()) == [
        "Missing channel element", "Story did not contain all required fields"]


def hn_story(id_, rank="1.", votes='<td class="votelinks"></td>', href="https://e.com/a"):
    return (f"<tr class='athing submission' id='{id_}'><td><span class=\"rank\">{rank}</span></td>"
            f'{votes}<td class="title"><span class="titleline"><a href="{href}" rel="x">T &amp; '
            f"<b>{id_}</b></a><span class=\"sitebit\"> (<a href='from'>e.com</a>)</span></span></td></tr>")


def hn_info(id_, talk="12&nbsp;comments", score=True):
    points = f'<span class="score" id="score_{id_}">1,234 points</span>' if score else ""
    return (f'<tr><td class="subtext"><span class="subline">{points} by <a href="u">u</a> '
            f'<span class="age" title="2024-10-26T14:38:11 1729953491"><a href="i">3 hours ago</a></span>'
            f' | <a href="hide">hide</a> | <a href="item?id={id_}">{talk}</a></span></td></tr>')


def test_hacker_news(spark):
    body = ("<table><tr><td><table>" + hn_story("1") + hn_info("1") + '<tr class="spacer"></tr>'
            + hn_story("2", "2.", href="item?id=2") + hn_info("2", "discuss")
            + hn_story("3", votes="") + hn_info("3") + hn_story("4", "4.") + hn_info("5")
            + hn_story("6", "x") + hn_info("6", score=False) + "</table></td></tr></table>")
    out = payloads.parse_hacker_news(frame(spark, ("hacker_news", body)))
    rows = {r.id: r for r in out.scrapes.collect()}
    assert set(rows) == {"1", "2"}
    assert (rows["1"].raw_title, rows["1"].points, rows["1"].comments, rows["1"].position) == (
        "T & 1", 1234, 12, 1)
    assert rows["1"].date == datetime(2024, 10, 26, 14, 38, 11)
    assert (rows["2"].url, rows["2"].comments) == ("https://news.ycombinator.com/item?id=2", 0)
    messages = Counter(r.message for r in out.warnings.collect())
    assert messages["Unmatched story/info for id 4"] == 1
    assert messages["Missing votelinks"] == 1 and messages["Failed to parse rank"] == 1
    assert messages["Missing ID on score node"] == 1
    assert messages["Story table cannot contain other tables"] == 1


def article(title="Big News Today", ext='<span><a class="story-sourcelnk" href="https://e.com/x?a=1&amp;b=2">(e)</a></span>',
            bubble='<span class="comment-bubble"><a href="#">12</a></span>', when="on Monday January 09, 2023 @08:25PM",
            topic="//slashdot.org/index2.pl?fhfilter=business", path="23/01/09/2025/big-news"):
    return (f'<article id="f" class="fhitem article usermode"><header><span class="topic"><a href="{topic}">'
            f'<img></a></span><h2 class="story"><span id="t" class="story-title"><a href="//tech.slashdot.org/story/{path}">'
            f"{title}</a> {ext}</span>{bubble}</h2></header><div><time datetime='x'>{when}</time></div></article>")


def test_slashdot(spark):
    body = "<body>" + "".join([
        article(), article(bubble=""), article(title="Tiny"), article(ext=""), article(path="23/01"),
        article(when="soon"), article(bubble='<span class="comment-bubble">many</span>'),
        '<article class="other">x</article>']) + "</body>"
    out = payloads.parse_slashdot(frame(spark, ("slashdot", body)))
    rows = out.scrapes.orderBy("comments").collect()
    assert [(r.id, r.comments, r.tags, r.url) for r in rows] == [
        ("23/01/09/2025", c, ["business"], "https://e.com/x?a=1&b=2") for c in (0, 12)]
    assert rows[0].date == datetime(2023, 1, 10, 1, 25)
    assert sorted(r.message for r in out.warnings.collect()) == sorted([
        "Title was too short", "Missing external link", "Invalid link format",
        "Failed to parse date", "Failed to parse number of comments"])


@pytest.mark.parametrize("href", ["//slashdot.org/index2.pl?fhfilter=business",
                                  "/index2.pl?fhfilter=business", "https://slashdot.org/?x=1&fhfilter=business"])
def test_topic(apply, href):
    assert apply(payloads.slashdot_topic, [href, "/none"]) == ["business", None]


def test_failed_fetch_is_a_warning(spark):
    out = payloads.scrape_payloads(frame(spark, ("reddit", "x"), ("lobsters", "y"), status=503))
    assert out.scrapes.count() == 0
    assert all(r.message.startswith("HTTP 503") for r in out.warnings.collect())


def test_one_pass_has_scrapes_and_warnings(spark):
    """Both outputs are the rows of one pass, with copies of a payload and of its broken lines."""
    hn = "<table>" + hn_story("1") + hn_info("1") + 2 * '<tr class="spacer"></tr>' + hn_story("2", votes="") + hn_story("3") + "</table>"
    good = [(7, "hacker_news", "u", 200, hn, None)] * 2 + [(8, "slashdot", "u", 200, article() + article(title="Tiny"), None)]
    rest = [(9, "reddit", None, 503, "x", None), (10, "attic", "u", 200, "", None), (11, "lobsters", "u", 200, "no", None),
            (12, "reddit", "u", 200, json.dumps({"data": {"children": [child("a"), child("b", num_comments=-1), child("c", score=1e12)]}}), None)]
    out = payloads.scrape_payloads(spark.createDataFrame(good + rest, PAYLOADS))
    rows = out.rows.collect()
    assert Counter((r.payload, r.id) for r in rows if r.accepted) == {(7, "1"): 1, (8, "23/01/09/2025"): 1, (12, "a"): 1}
    assert Counter((r.payload, r.message) for r in rows if not r.accepted) == {
        (7, "Unknown node type"): 4, (7, "Missing votelinks"): 2, (7, "Unmatched story/info for id 3"): 1,
        (8, "Title was too short"): 1, (9, None): 1, (10, "No parser for source attic"): 1,
        (11, "Missing channel element"): 1, (12, "Bad integer num comments"): 1, (12, "Bad integer score"): 1}
    assert all(r.message is None if r.accepted else r.id is None and r.shard is None for r in rows)
    assert out.scrapes.columns == ["payload", *[c for c in out.rows.columns if c not in ("payload", "accepted", "message")]]
    assert out.scrapes.count() == 3 and out.warnings.columns == ["payload", "source", "message"]
    assert Counter(out.warnings.collect()) == Counter((r.payload, r.source, r.message) for r in rows if not r.accepted)


def test_query_parses_each_payload_once(spark, sf):
    import checks
    plan = checks.QUERIES["scrape_payloads"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 1 and plan.count("posexplode(split(body") == 2  # one feed, two kinds of pages


def test_posts(spark, tmp_path):
    (tmp_path / "2024-06-06.md").write_text("---\ntags: rust, perf\ntitle: Fast & \"Small\": It_works\n---\nbody\n")
    (tmp_path / "2024-07-01.md").write_text("no front matter")
    row, = posts.posts(posts.read_post_files(spark, str(tmp_path)), "example.org").collect()
    assert row.url == "https://example.org/blog/2024-06-06/fast--small-it_works"
    assert row.tags == ["rust", "perf", "blog"]


def test_crawl_plan(spark):
    urls = sorted(r.url for r in crawl.crawl_plan(crawl.subsources(spark)).collect())
    reddit = [u for u in urls if "reddit" in u]
    assert len(urls) == 8 and len(reddit) == 4
    assert reddit[0] == "https://reddit.com/r/appengine+compilers+compsci+csbooks+golang/.json?limit=50"


def test_backup_records(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text('{"HackerNews":{"id":"hacker_news-1","url":["http://e.com","e.com","e.com"],"raw_title":"t",'
                    '"date":1700000000,"points":1,"comments":2,"position":3}}\n'
                    '{"Feed":{"id":"feed-2","url":"http://f.com","raw_title":"u","date":5,"tags":["a"]}}\n'
                    '{"Feed":{"id":"fe')
    rows = {r.scrape_id: r for r in backup.read_backup(spark, str(path)).collect()}
    assert rows["hacker_news-1"].url == "http://e.com" and rows["feed-2"].tags == ["a"] and len(rows) == 2
    bad = spark.createDataFrame([('{"Nope": 1}',)], "value STRING")
    with pytest.raises(Exception, match="bad backup record"):
        backup.from_records(bad).collect()
    assert backup.from_records(bad, strict=False).count() == 0


def test_faithful_slashdot_times(spark):
    out = payloads.parse_slashdot(frame(spark, ("slashdot", article())),
                                  SourceConfig(slashdot_times_are_eastern=False)).scrapes
    assert out.select(F.hour("date")).first()[0] == 20
