"""Score terms, as expressions over core rows and stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IMAGE_HOSTS, SOURCES, EngineConfig, ScoreConfig
from ..functions import urls

# Names of the per-scrape terms, in the order they are reported.
SCRAPE_TERMS = ("Position", "Source", "ImageLink", "CommentCount", "SelfLink",
                "LongRedditTitle", "PoorUpvoteRatio", "UpvoteCount")


def _per_source(values: dict) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(F.col("source") == name, F.lit(float(value))).otherwise(out)
    return out


def scrape_terms(cfg: ScoreConfig) -> dict[str, Column]:
    """Term name -> value, null when the term does not apply to the scrape."""
    source, host = F.col("source"), F.col("host")
    reddit = source == "reddit"
    rank = F.least(F.greatest(F.col("rank"), F.lit(0)), F.lit(30))
    weight = F.coalesce(_per_source(cfg.service_rank), F.lit(0.0))
    image = F.lit(False)
    for word in IMAGE_HOSTS:
        image = image | host.contains(word)
    talk = F.col("comments")
    ups = F.col("upvotes")
    return {
        "Position": F.when(F.col("rank").isNotNull(), (30 - rank) * weight),
        "Source": F.when(_per_source(cfg.service_boost) > 1e-7, _per_source(cfg.service_boost)),
        "ImageLink": F.when(image, F.when(source == "hacker_news", -5.0).otherwise(-10.0)),
        "CommentCount": (
            F.when(source.isin("hacker_news", "lobsters", "slashdot") & (talk > 100), 5.0)
            .when(reddit & (talk < 10), -5.0)
            .when(reddit & (talk > 10), 5.0)),
        "SelfLink": F.when(reddit & host.contains("reddit.com"), -20.0),
        "LongRedditTitle": F.when(reddit & (F.octet_length("title") > 130), -5.0),
        "PoorUpvoteRatio": F.when(reddit & (F.col("upvote_ratio") < 0.6), -20.0),
        # A bonus for more than 100 upvotes never applies: the "> 10" case comes first.
        "UpvoteCount": F.when(reddit & (ups < 10), -20.0).when(reddit & (ups > 10), 10.0),
    }


def single_score(cfg: ScoreConfig) -> Column:
    total = F.lit(0.0)
    for value in scrape_terms(cfg).values():
        total = total + F.coalesce(value, F.lit(0.0))
    return total


def with_single_score(core: DataFrame, cfg: ScoreConfig) -> DataFrame:
    return core.withColumn("single_score", single_score(cfg))


def age_score(hours: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    """Piecewise linear in hours; a negative age counts as zero."""
    b1, b2 = (24.0 * d for d in cfg.age_breakpoint_days)
    s0, s1, s2 = cfg.hour_scores
    h = F.greatest(hours, F.lit(0.0))
    return (F.when(h < b1, h * s0)
            .when(h < b2, b1 * s0 + (h - b1) * s1)
            .otherwise(b1 * s0 + (b2 - b1) * s1 + (h - b2) * s2))


def age_hours(now: Column, ts: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(3.6e9)


def story_terms(cfg: ScoreConfig) -> dict[str, Column]:
    """Story-level terms over url_norm, host, title and n_scrapes."""
    terms = {
        "Random": urls.jitter(F.col("url_norm")) if cfg.jitter else F.lit(0.0),
        "SourceCount": F.pow(F.col("n_scrapes").cast("double"), F.lit(cfg.power)) * cfg.factor,
        "LongTitle": F.when(F.octet_length("title") > 250, -15.0),
    }
    if cfg.site_name:
        terms["MetaStory"] = F.when(F.col("host").contains(cfg.site_name), 50.0)
    return terms


def story_score(cfg: ScoreConfig) -> Column:
    """Story terms plus the best scrape's score of every source.

    Expects ``best`` as a map from source to struct(single_score, ...).
    """
    total = F.lit(0.0)
    for value in story_terms(cfg).values():
        total = total + F.coalesce(value, F.lit(0.0))
    for name in SOURCES:
        total = total + F.coalesce(F.col(f"best_{name}.single_score"), F.lit(0.0))
    return total


def _term_rows(df: DataFrame, keys: list[str], terms: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("reason"), v.cast("double").alias("value"))
                     for n, v in terms.items()])
    return (df.select(*keys, F.explode(rows).alias("t"))
            .select(*keys, "t.reason", "t.value").where(F.col("value").isNotNull()))


def scrape_term_rows(core: DataFrame, cfg: ScoreConfig, keys: list[str]) -> DataFrame:
    """Long form of the per-scrape terms: keys, reason, value."""
    return _term_rows(core, keys, scrape_terms(cfg))


def score_detail(best_scrapes: DataFrame, stories: DataFrame, now: Column,
                 cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Every term behind every story's score: story_id, source, reason, value.

    ``best_scrapes`` holds the best core row per (story_id, source).
    """
    per_story = {"Age": age_score(age_hours(now, F.col("date")), cfg.score),
                 **story_terms(cfg.score)}
    top = _term_rows(stories.withColumn("source", F.lit(None).cast("string")),
                     ["story_id", "source"], per_story)
    low = scrape_term_rows(best_scrapes, cfg.score, ["story_id", "source"])
    return top.unionByName(low)
