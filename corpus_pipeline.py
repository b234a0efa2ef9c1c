"""The corpus pipeline: five stages, each an operator of ``linkloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns the next stage's documents; ``run`` writes
each stage's result as Parquet into the shared folder and reads it again, so that a lost
executor never repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import mixing, packing, quality_rules, simhash, site_quality
from linkloom.llm.common import stored
from linkloom.llm.queries import word_bpe


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least the threshold."""
    model = site_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return site_quality.judge(docs, model).where("kept").select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's adaptive fences."""
    return quality_rules.apply_rules(docs).where("kept").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id. Near are
    texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return simhash.deduplicate(docs, shingle=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken, with the taken blocks' words where not all are."""
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    return mixing.write_out(mixing.mix(sized), docs.columns, n_chars="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096 tokens."""
    pieces = packing.tokenize(docs, word_bpe())
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("simhash_near_dedup", dedup),
          ("mixing", mix), ("best_fit_packing", pack)]

#: SQL can express neither the fitted classifier nor XXH64 nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
