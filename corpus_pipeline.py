"""From raw documents to packed training sequences: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrywell.llm import jaccard_join, line_dedup, packing, quality, suffix_dedup
from ferrywell.session import Staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality.filtered(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go, and documents of which nothing is left."""
    return line_dedup.cleaned(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.distinct_documents(docs)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes or more that stand elsewhere too go."""
    return suffix_dedup.cleaned(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("ngram_jaccard", near_copies),
    ("suffix_dedup", long_repeats),
    ("packing", sequences),
]
#: Token ids cannot be stated in SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn; what a stage read goes once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        step = Staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.release()
        docs, before = step.df, step
    return docs
