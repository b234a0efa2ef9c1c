"""Explicit table schemas. Nothing in the library infers a schema."""

SCRAPES = """
    shard INT, scrape_id STRING, source STRING, subsource STRING, id STRING,
    url STRING, raw_title STRING, date TIMESTAMP,
    position BIGINT, points BIGINT, comments BIGINT, score BIGINT, upvotes BIGINT,
    downvotes BIGINT, upvote_ratio FLOAT, flair STRING, tags ARRAY<STRING>
"""

PAYLOADS = """
    payload BIGINT, source STRING, url STRING, status INT, body STRING,
    fetched_at TIMESTAMP
"""

RSS_CHANNEL = """
    channel STRUCT<item: ARRAY<STRUCT<
        title: STRING, link: STRING, guid: STRUCT<_VALUE: STRING, _isPermaLink: STRING>,
        pubDate: STRING, category: ARRAY<STRING>>>>
"""

PAGE_EVENTS = "ts TIMESTAMP, path STRING, referrer STRING, agent STRING, ip STRING"

SCRAPE_COLUMNS = [
    "shard", "scrape_id", "source", "subsource", "id", "url", "raw_title", "date",
    "position", "points", "comments", "score", "upvotes", "downvotes", "upvote_ratio",
    "flair", "tags",
]
