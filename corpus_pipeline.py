"""From documents to packed sequences: quality rules, exact dedup, near-dedup, substring dedup, packing.

Each stage gets what the one before kept, as a table, and applies one operator of inkfold.llm to all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfold.llm import exact_dedup, packing, quality_rules, simhash, substring_dedup
from inkfold.llm.common import materialize
from inkfold.llm.queries import BYTE_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that are similar by five-word shingles one stays."""
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut out of the texts; every document stays."""
    return substring_dedup.cut_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings), ("best_fit_packing", pack)]

#: SQL can express neither the fingerprints' components nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
