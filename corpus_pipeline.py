"""Corpus pipeline: quality rules, one document of each near-duplicate group, repeated passages out, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. ``run`` stores each stage's rows before the next one reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarte.llm import jaccard, outliers, packing, repeats
from quarte.llm.common import stage, table

#: The stages fit, link and suffix-sort; SQL has no form for them. Tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers for their language and source."""
    return outliers.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked documents."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that also start earlier."""
    return repeats.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
