"""Corpus cleaning pipeline: each stage works on what the stage before it kept, written down in between.

1. quality: documents that the classifier rejects go.
2. near_dedup: of each group of documents linked by a similarity of 0.8 or more the one with the smallest doc_id stays.
3. decontaminate: documents with an occurrence of a benchmark window go.
4. pii: entities get surrogates; n_chars follows the new text.
5. bpe: texts are encoded and decoded; the result has the digests.

All stages but the last return the columns of documents. Rows that share a doc_id go or stay together in the second
stage; a null doc_id can't be joined to a decision and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm._stage import drop_staged, staged
from sparkquill.llm.fm_index import hits
from sparkquill.llm.quality_trees import quality_scores
from sparkquill.llm.queries import surrogate_key
from sparkquill.llm.setsketch import near_duplicates
from sparkquill.llm.surrogates import pseudonymize
from sparkquill.llm.word_bpe import digest, encode_and_decode

#: The least similarity of near copies, on runs of five words.
NEAR = 0.8


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one value, so that none of them meets a name that an operator uses."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")).alias("box"))


def _unboxed(found: DataFrame, columns: list[str]) -> DataFrame:
    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"box.`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality_scores(_boxed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id", "text", "box"])
    return _unboxed(scored.filter("predicted = 1"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = staged(near_duplicates(docs, NEAR).filter("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = hits(_boxed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id", "text", "box"])
    return _unboxed(found.filter("n_hit = 0"), docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = pseudonymize(docs, surrogate_key(spark))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("_n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest(encode_and_decode(docs))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]

#: The trees and merges have no SQL. A test holds run() against plain Python, with the classifier's verdicts taken as they are.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:  # what the stage before wrote has been read for the last time
            drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
