"""Exact vector search and a hashed bag-of-words embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sparkquill.functions import text as T
from sparkquill.operators.lexical import rank_by


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Queries that are sent to the vectors' tasks at a time: this many vectors bound a broadcast.
QUERY_BLOCK = 4096
#: Pairs of a query and a vector that are compared at a time, and texts that are embedded together: they bound a task's memory, whatever the size of a batch.
CELLS, ROWS = 1 << 21, 2048


def few_of_ties(ids: pa.Array, at_q: np.ndarray, at_v: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Which of the pairs (question, vector) to keep: of those with the same question and value the k smallest ids, so that copies of one vector don't all come back."""
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    order = np.lexsort((place[at_v], value, at_q))
    q, v = at_q[order], value[order]
    starts = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))) if len(q) else np.zeros(0, np.int64)
    in_run = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[in_run < k]


def _best(block, k: int):
    """chunk_id, embedding -> the rows of each batch that can be among the k best of a query of the block: qid, chunk_id, cosine.

    A batch is compared CELLS pairs at a time. What a task has seen before counts: a row under its query's k-th best value so far can't matter.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = block.value
        best = np.full((len(q), k), -np.inf)  # the k largest values of each query so far
        step = max(1, CELLS // max(len(q), 1))
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for width in np.unique(lengths).tolist():
                if width != q.shape[1]:
                    raise ValueError(f"a vector has {width} values, the queries have {q.shape[1]}")
            found = []
            for lo in range(0, batch.num_rows, step):
                part = batch.column(1).slice(lo, step)
                v = np.asarray(part.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(part), -1)
                norms = np.sqrt((v * v).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine = (q @ v.T) / norms[None, :]
                rank = np.where(np.isnan(cosine), -np.inf, cosine)
                top = np.partition(rank, -k, axis=1)[:, -k:] if len(part) > k else rank
                best = np.partition(np.concatenate([best, top], axis=1), -k, axis=1)[:, -k:]
                at_q, at_v = np.nonzero(rank >= best.min(axis=1)[:, None] - 1e-6)  # equal ones, after rounding, are told apart later
                kept = few_of_ties(batch.column(0).slice(lo, step), at_q, at_v, rank[at_q, at_v], k)
                at_q, at_v = at_q[kept], at_v[kept]
                found.append((at_q, at_v + lo, cosine[at_q, at_v]))
            at_q, at_v, value = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            rank = np.where(np.isnan(value), -np.inf, value)
            kept = np.flatnonzero(rank >= best.min(axis=1)[at_q] - 1e-6)
            kept = kept[few_of_ties(batch.column(0), at_q[kept], at_v[kept], rank[kept], k)]
            yield pa.RecordBatch.from_arrays([pa.array(qids).take(pa.array(at_q[kept])), batch.column(0).take(pa.array(at_v[kept])), pa.array(value[kept])], ["qid", "chunk_id", "cosine"])

    return rows


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """qid, chunk_id, score (cosine, 6 decimals), rank. Rows without a vector don't take part; a zero vector's score is null and ranks last.

    The queries are the stated set: they are sent to the vectors' tasks `block` at a time, and one pass over the vectors, by
    matrix products, keeps the k best rows of each query and batch. Vectors are never shuffled.
    """
    spark = queries.sparkSession
    known = vectors.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    asked = queries.filter(F.col("embedding").isNotNull()).select("qid", "embedding")
    schema = StructType([asked.schema["qid"], known.schema["chunk_id"], StructField("cosine", DoubleType())])
    blocks = -(-asked.count() // block)
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()  # about `block` rows
        if part.num_rows:
            q = np.array(part.column("embedding").to_pylist(), dtype=np.float64)
            norms = np.sqrt((q * q).sum(axis=1, keepdims=True))
            q = np.divide(q, norms, out=np.full_like(q, np.nan), where=norms > 0)
            sent = spark.sparkContext.broadcast((part.column("qid").combine_chunks(), q))
            found = found.unionByName(known.mapInArrow(_best(sent, k), schema))
    score = F.when(F.isnan("cosine"), F.lit(None).cast("double")).otherwise(F.round("cosine", 6))
    return rank_by(found.select("qid", "chunk_id", score.alias("score")), k, ["qid"], F.desc_nulls_last("score"), F.col("chunk_id"))


def hash_bucket(token: Column, dim: int) -> Column:
    """md5 of a token as a number, modulo dim."""
    digest = F.md5(token.cast("binary"))
    remainder = F.lit(0).cast("long")
    for part in range(4):  # 32 bits at a time
        remainder = F.pmod(remainder * (2**32 % dim) + F.conv(F.substring(digest, part * 8 + 1, 8), 16, 10).cast("long"), F.lit(dim))
    return remainder.cast("int")


def _embedded_rows(dim: int):
    """key, words -> key, embedding; a word's bucket is computed once in a batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            bucket = np.array([int(hashlib.md5(w.encode()).hexdigest(), 16) % dim for w in coded.dictionary.to_pylist()], dtype=np.int64)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            cell = row * dim + bucket[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
            count = np.bincount(cell, minlength=batch.num_rows * dim).reshape(-1, dim).astype(np.float64)
            norm = np.sqrt((count * count).sum(axis=1, keepdims=True))
            value = np.divide(count, norm, out=np.zeros_like(count), where=norm > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * dim, pa.int32()), pa.array(value.ravel()))], [batch.schema.names[0], "embedding"])

    return rows


def hash_embedding(texts: DataFrame, key: str, text: str = "text", dim: int = 64) -> DataFrame:
    """key, embedding: word counts by hash (`hash_bucket`), of unit length; a text without words has the zero vector. A row's vector needs no other row: nothing is shuffled."""
    schema = StructType([StructField(key, texts.schema[key].dataType), StructField("embedding", ArrayType(DoubleType()))])
    return texts.select(key, T.words(F.col(text)).alias("words")).mapInArrow(_embedded_rows(dim), schema)
