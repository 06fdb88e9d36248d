"""The thin queries over the operators, by name, and their DuckDB counterparts where SQL has them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fixed_share, shared_dir, table, whole_text

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fixed_share(F.col("doc_id"), 4) == 2
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_toxicity(docs, model, keep_text=False).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fixed_share(F.col("doc_id"), 5) == 0
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_quality(docs, model, keep_text=False).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), emit_ids=False)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_trie import bpe_encode

    coded = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), decode=True, keep_text=False)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    # one cache for each set of tables: it outlives the session, so a second call finds all counts
    cache = f"{shared_dir(spark)}/factloom-token-counts/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), cache)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprint_text, near_dedup

    found = near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3)
    return found.select("doc_id", fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import in_training, score_lm, train_lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_lm(docs.where(in_training(F.col("doc_id"))))
    scored = score_lm(docs, model)
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    kept = line_dedup(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(whole_text(), 256).alias("text_sha256"))
    return exact_dedup(docs, carry=("text_sha256",))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_policy, policy_mask, rule_ledger

    ledger = apply_policy(rule_ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "2024.1")
    base_failed = F.col("fail_bits").bitwiseAND(F.lit(policy_mask("base")).cast("long")) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept")


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality_gam": op2_quality_gam,
        "op3_packing": op3_packing,
        "op4_bpe": op4_bpe,
        "op5_token_counts": op5_token_counts,
        "op6_simhash_dedup": op6_simhash_dedup,
        "op8_lm_scoring": op8_lm_scoring,
        "op7_line_dedup": op7_line_dedup,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import OP7, OP9, OP10

    return {"op7_line_dedup": OP7, "op9_exact_dedup": OP9, "op10_quality_rules": OP10}
