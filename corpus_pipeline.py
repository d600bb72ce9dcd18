"""The training-data pipeline: documents through quality rules to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdikt.llm.common import pin, table
from verdikt.llm.decontaminate import without_leaks
from verdikt.llm.packing import pack_documents
from verdikt.llm.quality_rules import keep_good
from verdikt.llm.queries import ALPHA, DELTA, good_labels, vocabulary
from verdikt.llm.secrets import mask_secrets
from verdikt.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs, good_labels(spark, sf_dir), alpha=ALPHA, delta=DELTA)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by the name of its kind; all documents stay."""
    return mask_secrets(docs, vocabulary()[1:])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its sequence and its place there."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Near duplicates by fingerprint and edit-budget alignment have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
