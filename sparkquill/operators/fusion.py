"""Reciprocal rank fusion and reranking of rankings (qid, chunk_id, rank)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.functions import text as T
from sparkquill.operators.lexical import rank_by
from sparkquill.staging import staged

RRF_K, POOL, RERANK_POOL = 60, 50, 20


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int) -> DataFrame:
    """Sum of 1 / (60 + rank) over the rankings; ties by chunk_id."""
    stacked = rankings[0].select("qid", "chunk_id", "rank")
    for other in rankings[1:]:
        stacked = stacked.unionByName(other.select("qid", "chunk_id", "rank"))
    fused = stacked.groupBy("qid", "chunk_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return rank_by(fused, k, ["qid"], F.desc("score"), F.col("chunk_id"))


def rerank(questions: DataFrame, chunks: DataFrame, base: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = T.overlap_score) -> DataFrame:
    """The base ranking's pool of max(k, 20), ordered by the scorer over question and plain chunk text, then by base rank."""
    pool = staged(base.filter(F.col("rank") <= max(k, RERANK_POOL)).select("qid", "chunk_id", F.col("rank").alias("base_rank")), "pool")  # of known size: the chunks aren't shuffled for a small one
    texts = pool.join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("qid", "question"), "qid")
    scored = texts.select("qid", "chunk_id", "base_rank", scorer(F.col("question"), F.col("text")).alias("score"))
    return rank_by(scored, k, ["qid"], F.desc("score"), F.col("base_rank"))
