"""Corpus pipeline: language ID, quality rules, line dedup, near-copy removal, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
a DataFrame that is written as Parquet and reread for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeglass.llm.common import cut
from tapeglass.llm.langid import keep_identified, train
from tapeglass.llm.linededup import dedup_lines
from tapeglass.llm.packing import pack_documents
from tapeglass.llm.quality import clean_documents
from tapeglass.llm.setjoin import keep_one_per_group


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go."""
    return keep_identified(docs, train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail or lose too much."""
    return clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal lines one stays."""
    return dedup_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal documents one stays."""
    return keep_one_per_group(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document in a window."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("packing", packing),
]

# A fitted labeller, MinHash bands and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
