"""Corpus preparation: quality, near duplicates, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes as
Parquet and reads again as the next stage's ``docs``. All but the last return the columns of
documents. Stages judge and drop rows, never identifiers, so rows that repeat a doc_id or have
none are treated by what they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from apiarium.llm import common, decontamination, mixing, ngram_join, quality, sharding
from apiarium.scratch import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of these documents, does not reject."""
    common.prepare(spark)
    return quality.keep_good(docs, quality.fit(docs, common.labels(spark, sf_dir)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near duplicates."""
    common.prepare(spark)
    return ngram_join.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    common.prepare(spark)
    return decontamination.clean(docs, common.benchmark(spark, sf_dir))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as its source's target takes it."""
    return mixing.draw(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mixture."""
    return sharding.kd_shards(docs, shards=40)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
