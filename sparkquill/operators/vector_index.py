"""An exact vector index: blocks of vectors near a centre, left out where no vector of a block can be among a question's k best.

Vectors go to the centre they are nearest to by angle and are cut into blocks by their angle to it. A vector x and a question q whose angles to a centre are
a and b are at least |a - b| apart (the triangle inequality of angles), so a block's least and greatest angle bound the cosine of all of its vectors. A question's
first blocks give it a floor, its k-th best cosine so far; blocks bounded below the floor are never read for it. Rows equal those of `vectors.vector_topk`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from sparkquill.operators.lexical import rank_by
from sparkquill.operators.ranks import in_order
from sparkquill.operators.vectors import few_of_ties, vector_topk
from sparkquill.staging import staged

CENTRES = 256  # at most; their matrix is sent to tasks
SAMPLE = 20_000  # vectors that the centres are fitted on; every vector is indexed
BLOCK = 512
QUESTIONS = 1024  # of one block that one task scores at a time
SLACK = 1e-6  # scores are compared after rounding
KEYS = ["cluster", "_part", "_b"]


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    v = np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)
    if width is not None and len(v) and v.shape[1] != width:
        raise ValueError(f"a vector has {v.shape[1]} values, not {width}")
    return v


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def fit_centres(v: np.ndarray, n: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Spherical k-means: unit centres, at most n; an empty one is dropped."""
    v = _unit(v)
    v = v[(v != 0).any(axis=1)]
    if not len(v):
        return v
    centres = v[np.random.default_rng(seed).permutation(len(v))[:n]]
    for _ in range(rounds):
        nearest = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, v)
        centres = _unit(sums[(sums != 0).any(axis=1)])
    return centres


def _bound(angle: Column, lo: Column, hi: Column) -> Column:
    """The greatest cosine that a vector between the angles lo and hi of a centre can have with a question at `angle` of it; null angles (zero vectors) bound nothing."""
    return F.coalesce(F.cos(F.greatest(F.lit(0.0), lo - angle, angle - hi)), F.lit(-1.0))


class VectorIndex:
    """chunk_id, embedding -> an index. Null embeddings take no part; zero vectors rank last, without a score. Tables are staged."""

    def __init__(self, vectors: DataFrame, centres: int = CENTRES, sample: int = SAMPLE, block: int = BLOCK) -> None:
        spark = vectors.sparkSession
        self.known = vectors.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
        some = self.known.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toArrow()  # bounded: `sample` rows
        v = _matrix(some.column(0).combine_chunks()) if some.num_rows else np.zeros((0, 1))
        self.centres = fit_centres(v, max(1, min(centres, int(len(v) ** 0.5))))
        self.width = v.shape[1]
        sent, width = spark.sparkContext.broadcast(self.centres), self.width

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                u = _unit(_matrix(batch.column(1), width))
                zero = ~(u != 0).any(axis=1)
                near = u @ sent.value.T if len(sent.value) else np.zeros((len(u), 1))
                cluster = np.where(zero, -1, near.argmax(axis=1)).astype(np.int32)
                angle = np.arccos(np.clip(near.max(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(angle, mask=zero)], ["chunk_id", "embedding", "cluster", "angle"])

        placed = in_order(self.known.mapInArrow(assign, StructType([*self.known.schema.fields, StructField("cluster", IntegerType()), StructField("angle", DoubleType())])), ["cluster", "angle", "chunk_id"])  # copies of one vector are dealt by their ids
        self.rows = placed.withColumn("_b", F.floor(F.col("_i") / block)).drop("_i")
        self.blocks = staged(self.rows.groupBy(*KEYS).agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n")), "blocks")

    def _angles(self, asked: DataFrame) -> DataFrame:
        """qid, cluster, angle for every centre, and the cluster of the zero vectors; `first` marks the nearest centre."""
        sent, width = self.known.sparkSession.sparkContext.broadcast(self.centres), self.width

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                cos = np.clip(_unit(_matrix(batch.column(1), width)) @ sent.value.T, -1, 1)
                n, c = cos.shape
                angle = np.concatenate([np.arccos(cos), np.zeros((n, 1))], axis=1)
                cluster = np.tile(np.append(np.arange(c), -1), n).astype(np.int32)
                qid = batch.column(0).take(pa.array(np.repeat(np.arange(n), c + 1)))
                first = np.tile(np.arange(c + 1), n) == np.repeat(cos.argmax(axis=1), c + 1)
                yield pa.RecordBatch.from_arrays([qid, pa.array(cluster), pa.array(angle.ravel(), mask=cluster == -1), pa.array(first)], ["qid", "cluster", "angle", "first"])

        return asked.mapInArrow(rows, StructType([asked.schema["qid"], StructField("cluster", IntegerType()), StructField("angle", DoubleType()), StructField("first", BooleanType())]))

    def _scores(self, pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """qid and block -> qid, chunk_id, cosine of the rows that can be among the k best of the block. A block that many questions ask for meets them in parts."""
        share = pairs.groupBy(*KEYS).agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("_parts"))
        left = self.rows.join(share, KEYS).select("chunk_id", "embedding", *KEYS, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_salt"))
        right = pairs.join(share, KEYS).join(asked, "qid").select("qid", "embedding", *KEYS, F.pmod(F.xxhash64("qid"), F.col("_parts")).cast("int").alias("_salt"))
        schema = StructType([asked.schema["qid"], self.known.schema["chunk_id"], StructField("cosine", DoubleType())])

        def score(v: pa.Table, q: pa.Table) -> pa.Table:
            if not v.num_rows or not q.num_rows:
                return pa.Table.from_arrays([q.column("qid").slice(0, 0), v.column("chunk_id").slice(0, 0), pa.array([], pa.float64())], ["qid", "chunk_id", "cosine"])
            x, u = _matrix(v.column("embedding").combine_chunks()), _unit(_matrix(q.column("embedding").combine_chunks()))
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = (u @ x.T) / np.sqrt((x * x).sum(axis=1))[None, :]
            rank = np.where(np.isnan(cosine), -np.inf, cosine)
            least = np.partition(rank, -k, axis=1)[:, -k] if len(x) > k else np.full(len(u), -np.inf)
            at_q, at_v = np.nonzero(rank >= least[:, None] - SLACK)
            kept = few_of_ties(v.column("chunk_id").combine_chunks(), at_q, at_v, rank[at_q, at_v], k)
            at_q, at_v = at_q[kept], at_v[kept]
            return pa.Table.from_arrays([q.column("qid").take(pa.array(at_q)), v.column("chunk_id").take(pa.array(at_v)), pa.array(cosine[at_q, at_v])], ["qid", "chunk_id", "cosine"])

        keys = [*KEYS, "_salt"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)

    def search(self, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """The rows of `vector_topk`, and the pairs of question and block that were read for them (qid, cluster, _part, _b). qids tell the questions apart."""
        asked = queries.filter(F.col("embedding").isNotNull()).select("qid", "embedding")
        zero = ~F.exists("embedding", lambda x: x != 0)
        idle, asked = asked.filter(zero), staged(asked.filter(~zero), "asked")
        if not len(self.centres):  # no vector has an angle
            return vector_topk(queries, self.known, k), self.blocks.select(F.lit(None).cast(asked.schema["qid"].dataType).alias("qid"), *KEYS).limit(0)
        angles = staged(self._angles(asked), "angles")
        near = angles.filter("first").join(self.blocks, "cluster").withColumn("_bound", _bound(F.col("angle"), F.col("lo"), F.col("hi")))
        order = Window.partitionBy("qid").orderBy(F.desc("_bound"), "_part", "_b").rowsBetween(Window.unboundedPreceding, -1)
        seeds = near.withColumn("_before", F.coalesce(F.sum("n").over(order), F.lit(0))).filter(F.col("_before") < k).select("qid", *KEYS)
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cosine")))
        floors = self._scores(seeds, asked, k).filter(~F.isnan("cosine")).withColumn("_at", place).filter(F.col("_at") == k).select("qid", (F.col("cosine") - SLACK).alias("floor"))
        least = F.coalesce("floor", F.lit(-2.0))  # fewer than k seeds: every block is read
        whole = self.blocks.groupBy("cluster").agg(F.min("lo").alias("c_lo"), F.max("hi").alias("c_hi"))  # a row for each centre
        open_ = angles.join(floors, "qid", "left").join(F.broadcast(whole), "cluster").filter(_bound(F.col("angle"), F.col("c_lo"), F.col("c_hi")) + 1e-9 >= least)
        pairs = staged(open_.join(self.blocks, "cluster").filter(_bound(F.col("angle"), F.col("lo"), F.col("hi")) + 1e-9 >= least).select("qid", *KEYS), "pairs")
        score = F.when(F.isnan("cosine"), F.lit(None).cast("double")).otherwise(F.round("cosine", 6))
        found = rank_by(self._scores(pairs, asked, k).select("qid", "chunk_id", score.alias("score")), k, ["qid"], F.desc_nulls_last("score"), F.col("chunk_id"))
        return found.unionByName(vector_topk(idle, self.known, k)), pairs

    def share_read(self, pairs: DataFrame) -> float:
        """Vectors read over all that reading every block for each of the questions would take."""
        read = pairs.join(self.blocks, KEYS).agg(F.sum("n")).first()[0] or 0
        every = (self.blocks.agg(F.sum("n")).first()[0] or 0) * pairs.select("qid").distinct().count()
        return read / every if every else 0.0
