"""Collection figures of a search, kept per month beside the stories.

A figure is (shard, field, token, n): in how many of a month's stories a field holds a token.
Fields are the tokens of ``title`` and ``tags``, whole tags with other characters than letters and
digits (``entry``), whole hosts (``host``, as a phrase of their tokens), and the month's ``total``
of stories and of tokens per field. Figures are sums, so a change of stories is a table of
signed figures that is added; a search reads a few rows of each month and no story of a month
without a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls

SCHEMA = "shard INT, field STRING, token STRING, n BIGINT"
KEY = ["shard", "field", "token"]


def _cells(field: str, tokens: Column) -> Column:
    known = F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>")))
    return F.transform(known, lambda t: _cell(field, t, F.lit(1)))


def _cell(field: str, token: Column, n: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), token.alias("token"), n.cast("bigint").alias("n"))


def month_figures(stories: DataFrame, sign: int = 1) -> DataFrame:
    """The figures of ``stories``; with ``sign`` -1 those to be taken away."""
    title, tags = text.text_tokens(F.col("title")), text.text_tokens(F.array_join("tags", " "))
    odd = F.filter(F.transform("tags", F.lower), lambda t: t.rlike(r"[^\p{L}\p{N}]"))
    total = [F.array(_cell("total", F.lit(name), n)) for name, n in (
        ("stories", F.lit(1)), ("title", F.size(title)), ("tags", F.size(tags)), ("host", F.size(urls.host_tokens(F.col("host")))))]
    host = F.when(F.col("host").isNotNull(), F.array(urls.host_phrase(F.col("host"))))
    cells = F.concat(_cells("title", title), _cells("tags", tags), _cells("entry", odd), _cells("host", host), *total)
    return (stories.select("shard", F.explode(cells).alias("c")).select("shard", "c.field", "c.token", "c.n")
            .groupBy(*KEY).agg((F.sum("n") * sign).alias("n")).where("n <> 0"))


def added(*tables: DataFrame) -> DataFrame:
    """The sum of figures; what comes to nothing is gone."""
    rows = tables[0].select(*KEY, "n")
    for t in tables[1:]:
        rows = rows.unionByName(t.select(*KEY, "n"))
    return rows.groupBy(*KEY).agg(F.sum("n").alias("n")).where("n <> 0")


def figure(field: str, token: Column, like: bool = False) -> Column:
    """An aggregate over a month's figures: how many stories hold the token (or, in a host,
    the phrase)."""
    same = F.col("token").contains(token) if like else F.col("token") == token
    return F.coalesce(F.sum(F.when((F.col("field") == field) & same, F.col("n"))), F.lit(0)).cast("bigint")
