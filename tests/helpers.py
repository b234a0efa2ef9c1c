"""Small scrape fixtures."""

from datetime import datetime

from pyspark.sql import functions as F

from linkloom.functions.ids import scrape_id
from linkloom.functions.months import month_of
from linkloom.schema import SCRAPE_COLUMNS

_FIELDS = ("source STRING, subsource STRING, id STRING, url STRING, raw_title STRING, "
           "date TIMESTAMP, position INT, points INT, comments INT, score INT, upvotes INT, "
           "downvotes INT, upvote_ratio FLOAT, flair STRING, tags ARRAY<STRING>, seq BIGINT")


def scrapes(spark, rows):
    """rows: dicts with at least source, id, url, raw_title, date (ISO text)."""
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    data = []
    for n, r in enumerate(rows):
        r = {"seq": n, **r, "date": datetime.fromisoformat(r["date"])}
        data.append(tuple(r.get(c) for c in names))
    df = spark.createDataFrame(data, _FIELDS)
    df = df.withColumn("shard", month_of(F.col("date"))).withColumn(
        "scrape_id", scrape_id(F.col("source"), F.col("subsource"), F.col("id")))
    return df.select(*SCRAPE_COLUMNS, "seq")


def hn(id_, url, title, date, **kw):
    return {"source": "hacker_news", "id": id_, "url": url, "raw_title": title, "date": date,
            "points": 1, "comments": 0, "position": 1, **kw}


def reddit(id_, sub, url, title, date, **kw):
    return {"source": "reddit", "subsource": sub, "id": id_, "url": url, "raw_title": title,
            "date": date, "position": 1, "upvotes": 10, "downvotes": 0, "comments": 10,
            "score": 1, "upvote_ratio": 1.0, "flair": "", **kw}


def lobsters(id_, url, title, date, tags=(), **kw):
    return {"source": "lobsters", "id": id_, "url": url, "raw_title": title, "date": date,
            "position": 1, "comments": 0, "score": 0, "tags": list(tags), **kw}


def slashdot(id_, url, title, date, tags=(), **kw):
    return {"source": "slashdot", "id": id_, "url": url, "raw_title": title, "date": date,
            "comments": 0, "tags": list(tags), **kw}
