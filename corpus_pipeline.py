"""Corpus cleaning in five stages, each of them one operator on what the one before kept.

Quality rules, near-duplicates, repeated substrings, benchmark decontamination, packing.
Each stage's result is written as Parquet and read again as the next one's documents.

Null and empty texts fail the quality rules, so no later stage sees one unless it emptied it.
Of repeated rows one stays (near-duplicates). Rows without a doc_id go through as others do.
Columns beside doc_id, text and n_chars are carried unread, whatever their names, up to the
last stage, which returns pieces. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, packing, quality, simhash, substr
from millrace.llm.common import Scratch, scratch_freed, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.keep_first(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that repeat elsewhere; those left without text go."""
    return substr.clean(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark spans; those that mostly are benchmark text go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_substrings),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with scratch_freed():
            docs = scratch.put(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs


#: Fingerprint components, suffix order and tokenisation are out of SQL's reach.
ORACLE_SQL: str | None = None
