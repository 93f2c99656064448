"""The vector index against the exact scan."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkquill.operators.vector_index import VectorIndex, fit_centres
from sparkquill.operators.vectors import few_of_ties, vector_topk

VECTORS, QUERIES = "chunk_id string, embedding array<double>", "qid int, embedding array<double>"


def clustered(seed, n, dim=16, topics=12):
    """Vectors about topics; the first has a third of them."""
    draw = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(size=(topics, dim))
    topic = np.where(draw.random(n) < 1 / 3, 0, draw.integers(0, topics, n))
    return (centres[topic] + draw.normal(scale=0.2, size=(n, dim))) * draw.uniform(0.5, 2, (n, 1))


def rows(df):
    return sorted((r.qid, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10])
def test_rows_equal_the_scan_and_blocks_are_left_out(spark, k):
    v = [(f"v{i:05d}", x.tolist()) for i, x in enumerate(clustered(2, 3000))]
    v += [("null", None), ("zero", [0.0] * 16), *[(f"copy{i}", v[7][1]) for i in range(15)]]
    q = [(i, x.tolist()) for i, x in enumerate(clustered(3, 40))] + [(90, [0.0] * 16), (91, None), (92, v[7][1])]
    held, asked = spark.createDataFrame(v, VECTORS), spark.createDataFrame(q, QUERIES)
    index = VectorIndex(held, block=64)
    found, pairs = index.search(asked, k)
    assert rows(found) == rows(vector_topk(asked, held, k))
    assert index.share_read(pairs) < 0.3
    assert index.blocks.agg(F.sum("n"), F.max("n")).first() == (3016, 64)


def test_every_block_is_read_where_nothing_can_be_left_out(spark):
    draw = np.random.default_rng(4)
    held = spark.createDataFrame([(f"v{i}", x.tolist()) for i, x in enumerate(draw.normal(size=(200, 8)))], VECTORS)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(draw.normal(size=(5, 8)))], QUERIES)
    index = VectorIndex(held, block=16)
    found, pairs = index.search(asked, 250)  # more than there are
    assert rows(found) == rows(vector_topk(asked, held, 250)) and index.share_read(pairs) == 1.0


def test_copies_come_back_k_at_a_time():
    ids = pa.array(["d", "b", "c", "a", "e"])
    at_q, at_v = np.array([0, 0, 0, 0, 1, 1]), np.array([0, 1, 2, 3, 0, 4])
    value = np.array([0.5, 0.5, 0.5, 0.4, -np.inf, -np.inf])
    kept = few_of_ties(ids, at_q, at_v, value, 2)
    assert sorted(zip(at_q[kept].tolist(), at_v[kept].tolist(), strict=True)) == [(0, 1), (0, 2), (0, 3), (1, 0), (1, 4)]
    assert len(few_of_ties(ids, at_q[:0], at_v[:0], value[:0], 2)) == 0


def test_odd_tables(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)
    none = VectorIndex(spark.createDataFrame([], VECTORS))
    assert none.search(one)[0].count() == 0
    zeros = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 0.0])], VECTORS)
    assert rows(VectorIndex(zeros).search(one)[0]) == rows(vector_topk(one, zeros))
    few = VectorIndex(spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0]), ("c", [1.0, 1.0])], VECTORS))
    assert [(r[2], r[3]) for r in rows(few.search(one)[0])] == [("b", 0.707107), ("c", 0.707107), ("a", None)]
    assert few.search(one.limit(0))[0].count() == 0
    assert len(fit_centres(np.zeros((3, 2)), 2)) == 0
