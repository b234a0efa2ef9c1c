"""Quality by hierarchical empirical Bayes: a document's own evidence on top of its site's.

1. A logistic classifier on a dozen measures of the text's form is fitted on a bounded sample
   of labelled documents (``sample`` rows, chosen by a hash of the id). Its log-odds without
   the base rate are the document's evidence.
2. All documents are grouped by host (source) and path (source and language). A group's
   posterior mean mixes the classifier's mean over its members with the level above: path with
   host, host with the global rate. The weight of the level above, in documents, is estimated
   from the spread between groups (method of moments), so sparse sites shrink towards the
   prior and large ones speak for themselves. The document itself is left out of its groups'
   figures, so that it does not count twice.
3. A document's quality is the posterior from its evidence and its path's rate.

Group figures are whole numbers (millionths), so that sums do not depend on their order. They
come from one aggregation with map-side combining and are joined back by key; a hot source
is one row there.

Defined results: a null text has the measures of an empty one; null source or language is a
group of its own; repeated rows count and are judged each on its own; labels that repeat for
one id are averaged, null labels ignored; without labels of both kinds the evidence is zero
and the prior one half, and everything is kept; an empty table gives an empty result. New
columns replace input columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from linkloom.llm.common import settle, sized, small_batches, whole_row, with_row

UNIT = 1_000_000

# Classes of bytes, for one pass over a text.
_CLASS = np.zeros(256, dtype=np.int64)
for _name, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
                                b".,;:?'\"()-", b"!", b"#*$%&|<>", b" \t\n\x0b\x0c\r"), start=1):
    _CLASS[np.frombuffer(_bytes, dtype=np.uint8)] = _name
_CLASS[128:] = 8

MEASURES = ("log_words", "distinct", "word_length", "upper", "digits", "points", "shouts", "symbols",
            "repeated_lines", "top_word", "line_words")


@dataclass(frozen=True)
class SiteSettings:
    sample: int = 20_000
    ridge: float = 1.0
    rounds: int = 30
    threshold: float = 0.5
    #: Bounds of the prior's weight, in documents.
    least: float = 1.0
    most: float = 10_000.0


def form(text: str | None) -> list[float]:
    """What a text looks like, as a dozen numbers."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=9)
    chars = float(kinds.sum() - kinds[7])
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [math.log1p(n), len(seen) / n ** 0.9, chars / n, kinds[2] / (kinds[1] + kinds[2] + kinds[8] + 1), kinds[3] / chars,
            min(kinds[4] / n, 2.0), min(kinds[5] / n, 2.0), min(kinds[6] / n, 2.0),
            1 - len(set(lines)) / max(1, len(lines)), max(seen.values()) / n if n > 9 else 0.0,
            math.log1p(n / max(1, len(lines)))]


@dataclass(frozen=True)
class Classifier:
    mean: tuple
    scale: tuple
    weights: tuple
    base: float

    def evidence(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds without the base rate's."""
        x = (rows - np.array(self.mean)) / np.array(self.scale)
        return np.clip(x @ np.array(self.weights[1:]) + self.weights[0] - _logit(self.base), -30, 30)


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def fit(rows: np.ndarray, good: np.ndarray, s: SiteSettings = SiteSettings()) -> Classifier:
    """Ridge logistic regression by Newton steps; without both kinds, no evidence at all."""
    k = len(MEASURES)
    if not len(good) or good.min() == good.max():
        return Classifier((0.0,) * k, (1.0,) * k, (0.0,) * (k + 1), 0.5)
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    x = np.c_[np.ones(len(rows)), (rows - mean) / scale]
    w, keep = np.zeros(k + 1), np.r_[1e-6, np.full(k, s.ridge)]
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (good - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(tuple(mean), tuple(scale), tuple(w), float(good.mean()))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          s: SiteSettings = SiteSettings()) -> Classifier:
    """Fit on at most about ``s.sample`` labelled documents, whatever the size of the tables."""
    small_batches(docs.sparkSession)
    known = (labels.select(F.col(f"`{doc_id}`").alias("_lid"), F.col(f"`{label}`").cast("double").alias("_y")).dropna()
             .groupBy("_lid").agg(F.avg("_y").alias("_y")))
    share = s.sample / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("_lid"), F.lit(UNIT)) < int(share * UNIT))
    shaped = F.pandas_udf(lambda t: pd.Series([form(x) for x in t]), "array<double>")
    # At most ``sample`` rows of two numbers, so the broadcast is bounded.
    got = (docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
           .join(F.broadcast(known), F.col("_id") == F.col("_lid"))
           .select("_id", "_y", shaped("_text").alias("x")).toPandas())
    # Always in one order, so that sums of floats come out alike.
    got = got.assign(key=[tuple(x) for x in got["x"]]).sort_values(["_id", "key"])
    rows = np.array(got["key"].tolist(), dtype=float).reshape(-1, len(MEASURES))
    return fit(rows, (got["_y"].to_numpy(dtype=float) >= 0.5).astype(float), s)


def _weight(mean: float, n: float, n2: float, groups: int, spread: float, s: SiteSettings) -> float:
    """How many documents the level above is worth: from the variance between groups beyond
    what their sizes explain."""
    if n <= 0 or groups < 2 or not 0 < mean < 1:
        return s.most
    noise = mean * (1 - mean)
    between = (spread - (groups - 1) * noise) / max(1e-9, n - n2 / n)
    return s.most if between <= 0 else min(s.most, max(s.least, noise / between - 1))


def judge(docs: DataFrame, model: Classifier, source: str = "source", lang: str = "lang", text: str = "text",
          s: SiteSettings = SiteSettings()) -> DataFrame:
    """The documents with evidence, host_rate, path_rate, quality and kept.

    The texts are measured twice, for the groups and for the verdict, and never shuffled.
    """
    small_batches(docs.sparkSession)
    c = F.col

    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(np.round(model.evidence(np.array([form(x) for x in texts])), 6))

    # Non-deterministic only so that it is evaluated once per row.
    scored = F.pandas_udf(score, DoubleType()).asNondeterministic()
    rows = docs.select(whole_row(docs).alias("_row"), c(f"`{source}`").alias("_host"), c(f"`{lang}`").alias("_path"),
                       scored(c(f"`{text}`").cast("string")).alias("_e"))
    chance = 1 / (1 + F.exp(-(c("_e") + F.lit(_logit(model.base)))))
    rows = rows.withColumn("_p", F.round(chance * UNIT).cast("long"))
    paths = settle(rows.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_np"), F.sum("_p").alias("_sp")))
    hosts = paths.groupBy("_host").agg(F.sum("_np").alias("_nh"), F.sum("_sp").alias("_sh"))
    limits = (paths.select(c("_host").alias("_gh"), c("_path").alias("_gp"), "_np", "_sp")
              .join(hosts, c("_gh").eqNullSafe(c("_host"))).drop("_host"))
    limits = settle(limits)
    # The spread of the levels: one row.
    total = hosts.agg(F.sum("_nh").alias("n"), F.sum("_sh").alias("t"), F.sum(c("_nh").cast("double") ** 2).alias("n2"),
                      F.count(F.lit(1)).alias("g"), F.sum(c("_sh").cast("double") ** 2 / c("_nh")).alias("q")).first()
    n = float(total.n or 0)
    mean = (total.t or 0) / (n * UNIT) if n else 0.5
    host_k = _weight(mean, n, total.n2 or 0, total.g, (total.q or 0) / UNIT ** 2 - n * mean ** 2, s)
    inner = limits.agg(F.sum(c("_np").cast("double") ** 2 / c("_nh")).alias("n2"), F.count(F.lit(1)).alias("g"),
                       F.sum(c("_sp").cast("double") ** 2 / c("_np") - c("_sp").cast("double") * c("_sh") / c("_nh")).alias("q")).first()
    path_k = _weight(mean, n, (inner.n2 or 0), max(0, inner.g - (total.g or 0) + 1), (inner.q or 0) / UNIT ** 2, s)
    joined = rows.join(sized(limits), c("_host").eqNullSafe(c("_gh")) & c("_path").eqNullSafe(c("_gp")), "left")
    host = (host_k * mean + (c("_sh") - c("_p")) / UNIT) / (host_k + c("_nh") - 1)
    path = (path_k * host + (c("_sp") - c("_p")) / UNIT) / (path_k + c("_np") - 1)

    def inside(x: Column) -> Column:
        return F.greatest(F.least(x, F.lit(1 - 1e-6)), F.lit(1e-6))

    joined = joined.withColumns({"_hr": F.round(inside(host), 6), "_pr": F.round(inside(path), 6)})
    joined = joined.withColumn("_q", F.round(1 / (1 + F.exp(-(c("_e") + F.log(c("_pr") / (1 - c("_pr")))))), 6))
    return with_row(joined, "_row", ["evidence", "host_rate", "path_rate", "quality", "kept"],
                    [c("_e"), c("_hr"), c("_pr"), c("_q"), c("_q") >= s.threshold])
