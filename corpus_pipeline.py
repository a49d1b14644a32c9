"""A corpus from documents to packed sequences, in five stages of the corpus operators.

Each stage reads what its predecessor kept: the quality classifier drops what it
rejects, exact and near duplicates leave one document of each group, the mixture
repeats and leaves out documents so that sources meet their targets, and packing
returns the pieces of sequences. All but the last return documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import exact_dedup, mixture, near_dedup, packing, quality
from timberline.tables import keep, kept, release


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, added=True)


STAGES = [("quality", good), ("exact_dedup", unique), ("near_dedup", distinct), ("mixture", mixed), ("packing", packed)]

#: No SQL: a trained classifier and a tokenizer decide. tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again by the next; what it kept for itself goes when it is done."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), kept(spark)
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
        release(spark, since, last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
