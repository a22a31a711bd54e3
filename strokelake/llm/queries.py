"""The registered corpus queries: thin digests of the operators' outputs, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strokelake.llm import (
    conversations, decontaminate, grammar, hard_negatives, line_rules, near_dups, packing, quality_model, repeats, separators, site_lines, toxicity, wrappers,
)
from strokelake.llm.common import documents, table
from strokelake.llm.tokens import default_path
from strokelake.session import scratch_path

#: Words that the queries with no other large tables in a worker keep: about 13 MB per generation.
MANY_WORDS = 320_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_pattern_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder), default_path("word_bpe_49k.json"), capacity=2048, end_id=0, stored_words=MANY_WORDS)


@query("op2_separator_scan")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """The end id 50256 is no id of ordinary text, so it separates documents without an index."""
    path = scratch_path(spark, "flat")
    separators.write_flat(documents(spark, folder), path, default_path("byte_bpe_50k.json"), end_id=50256)
    return separators.document_counts(spark, path, end_id=50256)


@query("op3_line_frequency")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.judge(documents(spark, folder))


@query("op4_weak_labels")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(documents(spark, folder), table(spark, folder, "labels"))


@query("op5_inferred_wrappers")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(table(spark, folder, "pages"))


@query("op6_simhash_components")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, folder), radius=4)


@query("op7_benchmark_windows")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.mark_leaks(documents(spark, folder), table(spark, folder, "benchmark"))


@query("op8_deep_shallow_repeats")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, folder), width=400)


@query("op9_grammar_output")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "grammar")
    grammar.write_grammar(documents(spark, folder), path, default_path("byte_bpe_50k.json"), end_id=0, stored_words=MANY_WORDS)
    return grammar.read_grammar(spark, path)


@query("op10_site_spread", site_lines.ORACLE)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.remove_spread_lines(documents(spark, folder)).select("doc_id", "text", "n_lines", "n_removed")


@query("op11_grammar_repair", conversations.ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, folder, "conversations")))


@query("op12_quadratic_discriminant")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.score(documents(spark, folder), table(spark, folder, "labels"))


@query("op13_rtree_negatives", hard_negatives.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh label is moved on first; anchors are the rows whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    points = hard_negatives.quantised(table(spark, folder, "embeddings"), label=label)
    return hard_negatives.mine(points, F.col("id") % 100 == 0)
