"""The sweep against every rule tried on every url."""
import random

import pandas as pd
from pyspark.sql import functions as F

from linkloom.llm import queries, url_rules
from linkloom.llm.url_rules import judge

RULES = "host STRING, path STRING, verdict STRING"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
    host = rest.split("/")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[len(host):]


def plain(url, rules, default="allow"):
    host, path = parts(url)
    hits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules
            if host and h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(hits, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_random_rules_and_urls(spark):
    rng = random.Random(9)
    label = lambda: rng.choice(["a", "b", "ab", "com", "A-b", "é"])
    name = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    path = lambda n: "".join("/" + rng.choice(["", "x", "xy", "x y", "é"]) for _ in range(rng.randint(0, n)))
    rules = list({(name(2).lower(), path(2)): rng.choice(["allow", "block"]) for _ in range(80)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http{rng.choice(['', 's'])}://{name(4)}{path(4)}{rng.choice(['', '?q=/x://b', '#/x', '/?', 'z'])}" for _ in range(600)]
    urls += ["", None, "no scheme", "://", "http://", "x://A.B//x", "http://com?x", "http://.com/x", "http://a..com/", "HTTP://COM/X", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id LONG, url STRING").repartition(5)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, spark.createDataFrame(rules, RULES)).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}
    assert len({x[2] for x in got.values()}) > 20


def test_nested_rules_stay_open_across_partitions(spark):
    """Long runs of urls below nested rules, over many partitions."""
    rules = [("com", "/", "allow"), ("site.com", "/a/", "block"), ("site.com", "/a/b/", "allow"), ("site.com", "/a/b/c/", "block")]
    urls = [f"http://w{i % 3}.site.com/a/{'b/' if i % 2 else ''}{'c/' if i % 5 == 1 else ''}{i}" for i in range(900)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id LONG, url STRING")
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, spark.createDataFrame(rules, RULES)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_query(spark, sf):
    got = queries.QUERIES["op1_url_filters"](spark, sf).collect()
    urls = dict(pd.read_parquet(f"{sf}/pages.parquet")[["page_id", "url"]].itertuples(index=False))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain(u, queries.URL_RULES) for i, u in urls.items()}
    assert len(got) == len(urls)


def test_odd_rows(spark):
    rules = spark.createDataFrame([("COM", None, "block"), ("com", "", "allow"), (None, "/", "block"), ("", "/", "block")], RULES)
    pages = spark.createDataFrame([(1, "http://x.com/a"), (1, "http://x.com/a"), (None, "http://x.com/a"), (2, None), (3, "http://" + "l." * 300 + "com/" + "p" * 20_000),
                                   (4, "http://com/" + "p" * 1_000_000)],
                                  "page_id LONG, url STRING").withColumn("host", F.lit("old")).withColumn("key", F.lit(1)).withColumn("_h", F.lit(2))
    got = judge(pages, rules, default="block")
    assert got.columns == ["page_id", "url", "key", "_h", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == 6 and all(r.rule == ("com" if r.url else None) and r.verdict == "block" for r in rows)
    assert {r.verdict for r in judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert judge(pages.limit(0), rules).count() == 0
