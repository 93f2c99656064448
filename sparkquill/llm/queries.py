"""The queries of this subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm import oracles
from sparkquill.llm.chat_format import conversation_digests, hostile
from sparkquill.llm.filter_audit import filter_audit
from sparkquill.llm.fm_index import decontaminate
from sparkquill.llm.fm_index import digest as hit_digest
from sparkquill.llm.hilbert import hilbert_shards
from sparkquill.llm.host_rules import host_rules
from sparkquill.llm.merkle import verify_manifest
from sparkquill.llm.quality_trees import quality_scores
from sparkquill.llm.rans_tokens import token_digests
from sparkquill.llm.setsketch import near_duplicates
from sparkquill.llm.surrogates import pseudonymize
from sparkquill.llm.toxicity import toxicity_scores
from sparkquill.llm.warc import warc_round_trip
from sparkquill.llm.word_bpe import digest as id_digest
from sparkquill.llm.word_bpe import encode_and_decode


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op2_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), 0.85)


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"))


def op4_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_digest(encode_and_decode(_table(spark, sf_dir, "documents")))


def op5_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_restored")


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(_table(spark, sf_dir, "documents"))


def op7_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_digest(decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def surrogate_key(spark: SparkSession) -> str:
    """The secret in spark.sparkquill.surrogate.key. The synthetic tables, which hold nobody's data, do with a known one."""
    return spark.conf.get("spark.sparkquill.surrogate.key", "known key, for synthetic tables only")


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymize(_table(spark, sf_dir, "documents"), surrogate_key(spark))
    return out.select("doc_id", "text", F.col("_n_entities").alias("n_entities"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("shrunk_rate", 9).alias("shrunk_rate"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_manifest(_table(spark, sf_dir, "documents"))


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digests(hostile(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_boundary_chain": op1_warc_boundary_chain,
    "op2_setsketch_near_dedup": op2_setsketch_near_dedup,
    "op3_rans_tokens": op3_rans_tokens,
    "op4_word_bpe": op4_word_bpe,
    "op5_noisy_channel_toxicity": op5_noisy_channel_toxicity,
    "op6_hilbert_sharding": op6_hilbert_sharding,
    "op7_fm_index_decontamination": op7_fm_index_decontamination,
    "op8_surrogates": op8_surrogates,
    "op9_host_rules": op9_host_rules,
    "op10_quality_trees": op10_quality_trees,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_chat_windows": op13_chat_windows,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_boundary_chain": oracles.OP1,
    "op2_setsketch_near_dedup": oracles.OP2,
    "op6_hilbert_sharding": oracles.OP6,
    "op7_fm_index_decontamination": oracles.OP7,
    "op9_host_rules": oracles.OP9,
    "op11_filter_audit": oracles.OP11,
    "op12_merkle_manifest": oracles.OP12,
    "op13_chat_windows": oracles.OP13,
}
