"""From raw documents to an encoded training mix: each stage applies one operator.

Null, empty and very long texts, ties, repeated rows, empty tables and extra columns have
the results that the operators and `rowtide.llm.stages` state; no stage fails on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowtide.llm import stages
from rowtide.llm.common import stored, table
from rowtide.llm.pieces import encode_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of which no language can be told go: those without a letter, empty or null."""
    return stages.told_languages(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal after lower-casing A to Z, the one with the largest doc_id stays; of repeated rows one."""
    return stages.unlike_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies by SimHash, the document with the smallest doc_id stays."""
    return stages.apart_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times, or not at all."""
    return stages.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as pieces."""
    return encode_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix),
    ("SentencePiece", encode),
]
ORACLE_SQL = None  # the stages' models and sketches are not SQL; tests compare them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
