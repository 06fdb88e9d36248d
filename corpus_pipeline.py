"""Corpus pipeline: quality classifier, quality rules, line dedup, near-dedup, packing.

Every stage takes the session, the documents that its predecessor kept, and the folder of the
tables.  All but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fixed_share, table, written
from factloom.llm.line_dedup import line_dedup
from factloom.llm.packing import pack
from factloom.llm.quality_model import fit_quality, score_quality
from factloom.llm.quality_rules import apply_policy, rule_ledger
from factloom.llm.queries import tokenizer_path
from factloom.llm.near_copies import keep_one

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model gives 0.3 or more; it learns from all labelled rows but those held out."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fixed_share(F.col("doc_id"), 5) != 0)
    return score_quality(docs, model).where("predicted = 1").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return apply_policy(rule_ledger(docs), "2024.1").where("kept").select(*COLUMNS)


def shared_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that others hold."""
    kept = line_dedup(docs, min_chars=20, min_docs=3)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 of five-word shingles), the one with the least id."""
    return keep_one(docs, shingle=5, similarity=0.8).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("line_dedup", shared_line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("packing", packing),
]

#: A learned model, tokens and fingerprints are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
