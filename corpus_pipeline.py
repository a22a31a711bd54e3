"""The corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strokelake.llm.common import table, written
from strokelake.llm.decontaminate import drop_leaks
from strokelake.llm.packing import pack_documents
from strokelake.llm.shingle_sets import keep_one_similar
from strokelake.llm.site_lines import remove_spread_lines
from strokelake.llm.tokens import default_path
from strokelake.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in their first document only; no document goes. ``n_chars`` follows the text."""
    cleaned = remove_spread_lines(docs)
    return cleaned.selectExpr("doc_id", "text", "lang", "source", "CASE WHEN n_removed > 0 THEN CAST(length(text) AS BIGINT) ELSE n_chars END AS n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingle sets, Jaccard similarity of 0.8 or more."""
    return keep_one_similar(docs).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs, default_path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # models, fingerprints and tokenizers are beyond SQL; tests/llm compares each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
