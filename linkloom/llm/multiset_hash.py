"""Homomorphic multiset fingerprints of documents. DataFrame functions only.

A text is a multiset of paragraphs: its lines, cut further after ``. ``, ``! `` and ``? ``
(many lines hold a whole document), blank ones left out. A paragraph's MD5 gives a vector of
128 entries, +1 for a set bit and -1 for a clear one. A fingerprint is the sum of the vectors
modulo 2**16 in each lane, so it does not depend on the order of the paragraphs, equal
multisets have equal fingerprints, and paragraphs are added or taken out by adding or
subtracting their vectors (``combine``), without the rest of the text.

The lanes also tell how alike two texts are. For independent signs the squared length of
A - B is about 128 times the number of paragraphs not in common, so
``(|A|^2 + |B|^2 - |A - B|^2) / (|A|^2 + |B|^2)``, kept within 0 and 1, estimates twice the
common paragraphs over all paragraphs of both. Differences are read modulo 2**16 around 0.

Defined results: a null text is an empty one, whose fingerprint is all zero; two empty texts
are alike (1), an empty and another one are not (0); repeated rows have equal fingerprints;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import partitions

LANES = 128
MODULUS = 1 << 16


def paragraphs(text: Column) -> Column:
    for mark in (".", "!", "?"):
        text = F.replace(text, F.lit(f"{mark} "), F.lit(f"{mark}\n"))
    return F.split(text, "\n")


def signs(paragraph: Column) -> list[Column]:
    """MD5's 128 bits as two columns of 64: the hex digits are four 32-bit numbers, two to a
    column, the first one low. A null paragraph has none."""
    digest = F.md5(paragraph)
    w = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    return [F.coalesce(w[2 * k].bitwiseOR(F.shiftleft(w[2 * k + 1], 32)), F.lit(0).cast("long")).alias(f"_w{k}")
            for k in range(2)]


#: Bits 0 and 32: two counters of set bits share a column, of up to 2**31 paragraphs each.
_PAIR = (1 << 32) | 1


def bit_sums() -> list[Column]:
    return [F.sum(F.shiftrightunsigned(F.col(f"_w{k}"), i).bitwiseAND(F.lit(_PAIR))).alias(f"_b{k}_{i}")
            for k in range(2) for i in range(32)]


def lanes_of(count: Column) -> Column:
    """Signs add up to twice the set bits less the number of paragraphs."""
    low = lambda k: [F.col(f"_b{k}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(32)]
    high = lambda k: [F.shiftrightunsigned(F.col(f"_b{k}_{i}"), 32) for i in range(32)]
    return F.transform(F.array(*low(0), *high(0), *low(1), *high(1)), lambda b: F.pmod(2 * b - count, F.lit(MODULUS)))


def centred(lane: Column) -> Column:
    return F.when(lane >= MODULUS // 2, lane - MODULUS).otherwise(lane)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The lanes of two multisets together (1), or of the first without the second (-1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(MODULUS)))


def squared(lanes: Column) -> Column:
    return F.aggregate(lanes, F.lit(0).cast("long"), lambda s, x: s + centred(x) * centred(x))


def likeness(a: Column, b: Column) -> Column:
    both = squared(a) + squared(b)
    value = F.greatest(F.lit(0).cast("long"), both - squared(combine(a, b, -1))) / F.when(both > 0, both)
    return F.round(F.coalesce(F.least(F.lit(1.0), value), F.lit(1.0)), 6)


def as_text(lanes: Column) -> Column:
    """Four lower-case hex digits a lane."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def fingerprints(rows: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """The ``keys`` and the lanes of each text column, ``{column: name of its lanes}``.

    The keys tell the rows apart. If ``rows`` is partitioned by some of them, nothing is
    shuffled.
    """
    c = F.col

    def units(v: int, text: str) -> Column:
        # A null unit comes first, for texts without any paragraph.
        found = F.filter(paragraphs(F.coalesce(c(text), F.lit(""))), lambda p: F.btrim(p) != "")
        return F.concat(F.array(F.struct(F.lit(v).alias("v"), F.lit(None).cast("string").alias("p"))),
                        F.transform(found, lambda p: F.struct(F.lit(v).alias("v"), p.alias("p"))))

    split = rows.select(*keys, F.explode(F.concat(*[units(v, t) for v, t in enumerate(texts)])).alias("u"))
    words = split.select(*keys, c("u.v").alias("_v"), c("u.p").isNotNull().cast("long").alias("_one"), *signs(c("u.p")))
    sums = words.groupBy(*keys, "_v").agg(F.sum("_one").alias("_n"), *bit_sums())
    lanes = sums.select(*keys, "_v", lanes_of(c("_n")).alias("_l"))
    return lanes.groupBy(*keys).agg(*[F.first(F.when(c("_v") == v, c("_l")), ignorenulls=True).alias(name)
                                      for v, name in enumerate(texts.values())])


LAST = -(1 << 63)


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, pos, guest, doc_id, text): the rows dealt into ranges of descending doc_id and
    numbered inside their bucket, which ends with a ``guest``, a copy of the row that follows.

    The buckets' limits come from a quantile sketch of the ids, and their highest ids from an
    aggregation over them: one row per bucket, six times the shuffle partitions. A bucket's
    first row also goes to the bucket before, the very first to the last one, so every row
    finds the next one inside its bucket and the table is never sorted as a whole. Null ids
    come last; rows with equal ids follow each other by text.
    """
    c = F.col
    rows = docs.select(c(f"`{doc_id}`").alias("doc_id"), F.coalesce(c(f"`{text}`").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(c(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("_key"))
    side = int((6 * partitions(docs.sparkSession)) ** 0.5) + 1
    share = [i / side ** 2 for i in range(1, side ** 2)]
    cuts = sorted(set(rows.agg(F.percentile_approx("_key", share, 20 * side ** 2)).first()[0] or [0]))
    groups = [cuts[i:i + side] for i in range(0, len(cuts), side)]

    def below(limits: Column) -> Column:
        return F.size(F.filter(limits, lambda x: x < c("_key")))

    # In two steps, so that a row is compared with few limits.
    fine = F.array(*[F.lit(g) for g in groups])
    big = below(F.lit([g[-1] for g in groups]))
    rows = rows.withColumn("_big", big).withColumn("_small", F.coalesce(below(F.get(fine, c("_big"))), F.lit(0)))
    tops = {(r["_big"], r["_small"]): r.top for r in rows.groupBy("_big", "_small").agg(F.max("_key").alias("top")).collect()}
    order = sorted(tops)
    grid = [[(b, k) for k in range(side + 1)] for b in range(len(groups) + 1)]
    before = {x: order[(i + 1) % len(order)] for i, x in enumerate(order)}

    def at(values) -> Column:
        return F.get(F.get(F.array(*[F.array(*[F.lit(values(x)).cast("long") for x in line]) for line in grid]), c("_big")), c("_small"))

    wide = side + 1
    number = lambda x: x[0] * wide + x[1]
    own = F.struct((c("_big") * wide + c("_small")).cast("long").alias("bucket"), F.lit(False).alias("guest"))
    copy = F.struct(at(lambda x: number(before[x]) if x in before else None).alias("bucket"), F.lit(True).alias("guest"))
    dealt = F.when(c("_key") == at(lambda x: tops.get(x)), F.array(own, copy)).otherwise(F.array(own))
    rows = rows.select("doc_id", "text", "_key", F.explode(dealt).alias("_d"))
    rows = rows.select("_d.bucket", "_d.guest", "doc_id", "text", "_key")
    order_by = Window.partitionBy("bucket").orderBy("guest", F.desc("_key"), "text")
    return rows.select("bucket", F.row_number().over(order_by).alias("pos"), "guest", "doc_id", "text",
                       F.lead("text").over(order_by).alias("next_text"))


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside its edited text, whose last third is the start of the next
    document: doc_id, n_chars, edited_sha256, the lanes ``own`` and ``edited``, and their likeness to each
    other (near_edited) and to the next document's (near_next). One shuffle of the texts."""
    c = F.col
    rows = neighbours(docs, doc_id, text).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(c("n_chars") / 3).cast("int")
    rows = rows.withColumn("_edited", F.when(~c("guest"), F.concat(
        F.substring("text", F.lit(1), c("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))))
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256))
    keys = ["bucket", "pos", "guest", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprints(rows, keys, {"text": "own", "_edited": "edited"})
    order = Window.partitionBy("bucket").orderBy("pos")
    prints = prints.withColumn("_next", F.lead("own").over(order)).where(~c("guest"))
    return prints.select("doc_id", "n_chars", "edited_sha256", "own", "edited",
                         likeness(c("own"), c("edited")).alias("near_edited"), likeness(c("own"), c("_next")).alias("near_next"))
