"""URL filters as a sort-merge range join with a stack of nested rules.

A rule has a host and a path and fits its host and all subdomains, where the url's path starts
with the rule's. Keys are canonical: the host's labels reversed and joined with dots, a slash,
and the path (``com.example//en/``). A host holds no slash, so a rule's key is a prefix of the
key of every url it fits on that very host, and the urls that start with a prefix are an
interval of the sorted keys.

1. Each distinct (host, path) gives one key per ancestor of its host, so that subdomains
   meet the rules of their parents.
2. Rules and keys are range-partitioned and sorted together. A sweep keeps the stack of rules
   whose interval is open: a rule is pushed at its key and popped by the first key that does
   not start with it. The top of the stack is the longest rule of that host.
3. A partition may begin inside open intervals. Their rules are prefixes of its first key, so
   they are found by an equality join of each first key's prefixes with the rules: for every
   partition as many rows as a key is long, at most.
4. The longest rule over all ancestors wins, by length of host and path together, then by
   length of the host; it is joined back to the urls.

Rules are never broadcast; only step 3's few rows are, whose number is bounded by the number
of partitions times the length of a key.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no
rule; rules without a host are ignored, a null path is an empty one, and of equal rules with
different verdicts the blocking one counts; where no rule fits, the rule is null and the
verdict is the default; repeated urls are judged alike, each row on its own; an empty table
gives an empty result. New columns replace input columns of the same name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import settle, whole_row, with_row

ALLOW, BLOCK = "allow", "block"
# A-Z only, whatever the locale.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, and the path from
    there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    bare = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(bare, "/", 1)
    path = F.substring(bare, F.length(host) + 1, F.length(bare))
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def host_keys(host: Column) -> Column:
    """The host and all its ancestors, reversed: ``com``, ``com.example``, ..."""
    labels = F.reverse(F.split(host, "\\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))


def _sweep(carried: dict[int, list[tuple]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # (key, rule number) of the open rules, the longest last.
        stack = sorted(carried.get(TaskContext.get().partitionId(), []), key=lambda x: len(x[0]))
        for batch in batches:
            out = []
            for key, rule, page in zip(batch["key"], batch["rule"], batch["page"]):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if page is None:
                    stack.append((key, rule))
                elif stack:
                    out.append((page, stack[-1][1]))
            yield pd.DataFrame(out, columns=["page", "rule"])
    return run


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """The pages with host, path, rule (host and path of the winning rule) and verdict.

    ``rules`` has host, path and verdict (allow or block).
    """
    c = F.col
    named = (rules.select(F.translate(c("host").cast("string"), _UPPER, _LOWER).alias("h"),
                          F.coalesce(c("path").cast("string"), F.lit("")).alias("p"), c("verdict").alias("v"))
             .where(c("h").isNotNull() & (c("h") != ""))
             .groupBy("h", "p").agg(F.max("v").alias("v")))  # "block" is the greater one
    own = F.concat(F.array_join(F.reverse(F.split("h", "\\.")), "."), F.lit("/"), c("p"))
    # What the sweep hands on: length, host length, and the rule's own text and verdict.
    rule = F.struct((F.length("h") + F.length("p")).alias("size"), F.length("h").alias("host_size"),
                    F.concat("h", "p").alias("rule"), c("v").alias("verdict"))
    starts = settle(named.select(own.alias("key"), F.to_json(rule).alias("rule")))

    host, path = host_and_path(c(f"`{url}`").cast("string"))
    rows = pages.select(whole_row(pages).alias("_row"), host.alias("_host"), path.alias("_path"))
    places = rows.select("_host", "_path").where(c("_host") != "").distinct()
    page = F.to_json(F.struct(c("_host").alias("h"), c("_path").alias("p")))
    probes = places.select(page.alias("page"), F.explode(host_keys(c("_host"))).alias("k"), "_path")
    probes = probes.select(F.concat("k", F.lit("/"), "_path").alias("key"), F.lit(None).cast("string").alias("rule"), "page")
    events = starts.select("key", "rule", F.lit(None).cast("string").alias("page")).unionByName(probes)
    # A rule comes before the urls with the same key.
    swept = settle(events.repartitionByRange("key", F.asc_nulls_first("page"))
                   .sortWithinPartitions("key", F.asc_nulls_first("page")))
    first = (swept.select(F.spark_partition_id().alias("part"), "key").groupBy("part").agg(F.min("key").alias("key")))
    # Only prefixes as long as some rule: a path may have a million characters.
    sizes = sorted(r[0] for r in starts.select(F.length("key")).distinct().collect())  # of rules, not of urls
    shorter = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n < F.length("key"))
    prefixes = first.select("part", F.explode(F.transform(shorter, lambda n: F.substring(c("key"), F.lit(1), n))).alias("key"))
    carried: dict[int, list[tuple]] = defaultdict(list)
    for r in prefixes.join(starts, "key").collect():  # the rules open at a partition's first key
        carried[r.part].append((r["key"], r.rule))
    found = swept.mapInPandas(_sweep(dict(carried)), "page string, rule string")
    best = (found.select("page", F.from_json("rule", "size int, host_size int, rule string, verdict string").alias("r"))
            .groupBy("page").agg(F.max("r").alias("r"))
            .select(F.from_json("page", "h string, p string").alias("_at"), "r")
            .select(c("_at.h").alias("_h"), c("_at.p").alias("_p"), c("r.rule").alias("_rule"), c("r.verdict").alias("_verdict")))
    joined = rows.join(best, (c("_host") == c("_h")) & (c("_path") == c("_p")), "left")
    return with_row(joined, "_row", ["host", "path", "rule", "verdict"],
                    [c("_host"), c("_path"), c("_rule"), F.coalesce(c("_verdict"), F.lit(default))])
