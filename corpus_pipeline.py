"""The training-data pipeline: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and reread as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from windloom.llm import packing, quality, simhash, toxicity
from windloom.llm.common import release, store, stored_so_far


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier learned from ``labels.quality`` doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without significant toxic passages, as learned from ``labels.toxic``."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    return simhash.dedup(docs, shingle_words=5, similarity=0.8)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that stayed, in sequences of 2048 tokens mixed by source."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: No SQL: the classifiers, the fingerprints and the tokenizer are not expressible; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage stored on its way is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        mark = stored_so_far()
        docs = store(stage(spark, docs, sf_dir), name)
        release(spark, mark)
    return docs
