"""An inverted index in blocks of chunks, and exact top-k that leaves out the blocks that can't matter.

A block is a run of BLOCK chunks of one task, next to each other because they share words. A posting row says of a token and a block how many of its
chunks hold the token, its most occurrences in one, and the fewest words of one; a block's own row holds its chunks' words. Blocks are made where
their chunks are read, so building shuffles nothing; document frequencies and a token's bounds are sums and extremes over its rows.

A search has three steps, all of them joins and aggregations of the questions' terms with posting rows:

1. the SEED_BLOCKS blocks that a question's SEED_TERMS heaviest terms like best are scored; their k-th best score is a floor;
2. terms are split at the floor: chunks that hold none of a question's essential terms can't reach it. A block's bound is the sum of its largest
   values of essential terms, and the largest values anywhere of the rest; blocks bounded under the floor are left out;
3. the blocks that remain are scored exactly.

What a question costs follows from the rows of its essential terms and the blocks that remain, not from the number of chunks. A
question with fewer than k matches has no floor and reads every block that holds one of its terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkquill.staging import staged

BLOCK = 16
#: Chunks among which neighbours are looked for.
ROWS = 2048
SEED_TERMS, SEED_BLOCKS = 16, 16
#: Questions that meet a block at a time.
GROUP = 512
K1, B = 1.5, 0.75
#: Words of at least this share of a task's chunks say which chunks become neighbours.
SHARED = 0.1
#: Scores are compared after rounding to 6 decimals: bounds this close to the floor stay in.
SLACK = 1e-6


def _block_rows(size: int):
    """chunk_id, tokens -> posting rows of each block, and a row (token null) with the block's chunk_ids and words."""

    def block(part: pa.RecordBatch, b: int) -> pa.RecordBatch:
        lists, n = part.column(1), part.num_rows
        length = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        cell, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), length), return_counts=True)
        term, row = np.divmod(cell, n)
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        most, least = (f.reduceat(x, first) if len(first) else x for f, x in ((np.maximum, tf), (np.minimum, length[row])))
        t = len(first)
        whole = pa.array([*[0] * (t + 1), n], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([coded.dictionary.take(pa.array(term[first])).cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(np.full(t + 1, b), pa.int64()),
                *(pa.array(np.append(x, 0), pa.int32()) for x in (np.diff(np.append(first, len(term))), most, least)),
                pa.ListArray.from_arrays(whole, part.column(0)), pa.ListArray.from_arrays(whole, lists), pa.array([*[0] * t, int(length.sum())], pa.int64()),
            ],
            ["token", "b", "n", "most_tf", "least_words", "chunk_ids", "words", "n_tokens"],
        )

    def neighbours(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Chunks in order of what they share: of the words in SHARED of the batch or more, the first few in an arbitrary order."""
        lists, n = batch.column(1), batch.num_rows
        coded = lists.flatten().dictionary_encode()
        v = max(len(coded.dictionary), 1)
        row, term = np.divmod(np.unique(np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())) * v + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)), v)
        common = np.bincount(term, minlength=v) >= max(2, SHARED * n)
        place = np.random.default_rng(0).permutation(v)
        row, place = row[common[term]], place[term[common[term]]]
        order = np.lexsort((place, row))
        row, place = np.append(row[order], [-1] * 3), np.append(place[order], [-1] * 3)
        first = np.searchsorted(row[:-3], np.arange(n))
        keys = [np.where(row[first + j] == np.arange(n), place[first + j], -1) for j in range(3)]
        return batch.take(pa.array(np.lexsort(keys[::-1])))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = TaskContext.get().partitionId() << 32
        for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            batch = neighbours(batch)
            for lo in range(0, batch.num_rows, size):
                yield block(batch.slice(lo, size), b)
                b += 1

    return rows


def _score_rows(avgdl: float | None):
    """chunk_ids, words (of a block), qids, floors, tokens, ws (of some questions) -> qid, chunk_id, raw of the chunks that reach their question's floor with a match."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, qids, floors, tokens, ws = (batch.column(k)[i].values for k in range(6))
                count = np.diff(tokens.offsets.to_numpy())
                asked = tokens.flatten().dictionary_encode()
                term = asked.indices.to_numpy(zero_copy_only=False)
                length = words.value_lengths().to_numpy()
                at = pc.index_in(words.flatten(), value_set=asked.dictionary)
                met = at.is_valid().to_numpy(zero_copy_only=False)
                cell, tf = np.unique(at.drop_null().to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), length)[met], return_counts=True)
                value = tf.astype(np.float64)
                if avgdl is not None:
                    value = value * (K1 + 1) / (value + K1 * (1 - B + B * length[cell % len(ids)] / (avgdl or 1.0)))
                dense = np.zeros((len(asked.dictionary), len(ids)))
                dense.ravel()[cell] = value
                parts = dense[term] * ws.flatten().to_numpy()[:, None]
                total = np.add.reduceat(parts, np.cumsum(count) - count, axis=0)  # every question has a term
                q, c = np.nonzero((total > 0) & (total >= floors.to_numpy()[:, None]))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), ids.take(pa.array(c)), pa.array(total[q, c])], ["qid", "chunk_id", "raw"])

    return rows


class BlockIndex:
    """Posting and block rows of tokenized chunks (chunk_id, tokens), as a staged table, or one that `write` has written."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.spark: SparkSession = rows.sparkSession

    @classmethod
    def of(cls, tokenized: DataFrame, block: int = BLOCK) -> BlockIndex:
        kind = tokenized.schema["chunk_id"].dataType.simpleString()
        schema = f"token string, b long, n int, most_tf int, least_words int, chunk_ids array<{kind}>, words array<array<string>>, n_tokens long"
        return cls(staged(tokenized.select("chunk_id", "tokens").mapInArrow(_block_rows(block), schema), "postings"))

    def write(self, path: str, buckets: int = 64) -> None:
        """The index as a table in buckets of tokens, sorted by token, so that a reader of few tokens skips files and row groups."""
        dealt = self.rows.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
        spread = F.when(F.col("token").isNull(), F.col("b")).otherwise(F.lit(0))  # the blocks' own rows don't gather in one task
        dealt.repartition("bucket", spread).sortWithinPartitions("token", "b").write.partitionBy("bucket").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> BlockIndex:
        return cls(spark.read.parquet(path))

    @cached_property
    def postings(self) -> DataFrame:
        return self.rows.filter("token IS NOT NULL").select("token", "b", "n", "most_tf", "least_words")

    @cached_property
    def blocks(self) -> DataFrame:
        return self.rows.filter("token IS NULL").select("b", "chunk_ids", "words", "n_tokens")

    @cached_property
    def tokens(self) -> DataFrame:
        """The chunks again: chunk_id, tokens."""
        return self.blocks.select(F.explode(F.arrays_zip("chunk_ids", "words")).alias("_c")).select(F.col("_c.chunk_ids").alias("chunk_id"), F.col("_c.words").alias("tokens"))

    @cached_property
    def stats(self) -> DataFrame:
        """One row: n_chunks, avgdl (null without chunks)."""
        n = F.sum(F.size("chunk_ids"))
        return staged(self.blocks.agg(F.coalesce(n, F.lit(0)).alias("n_chunks"), (F.sum("n_tokens") / n).alias("avgdl")), "corpus_stats")

    @cached_property
    def avgdl(self) -> float:
        return self.stats.first()["avgdl"] or 0.0

    def bound(self, impact: bool):
        """The most that a token can add in a block, per unit of weight."""
        tf = F.col("most_tf")
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("least_words") / (self.avgdl or 1.0))) if impact else tf.cast("double")

    @cached_property
    def terms(self) -> DataFrame:
        """token, df, and the largest bound of both kinds."""
        return staged(self.postings.groupBy("token").agg(F.sum("n").alias("df"), F.max(self.bound(True)).alias("most"), F.max(self.bound(False)).alias("most_tf")), "terms")

    def search(self, asked: DataFrame, k: int, impact: bool = True) -> Search:
        """Top-k for weighted terms (qid, token, w; no w under 0). A chunk's score is the sum over its terms of w times impact, or times occurrences."""
        return Search(self, asked, k, impact)


class Search:
    """One search: `pairs` are the (qid, b) that were scored, `scores` the scores (qid, chunk_id, raw) that can matter."""

    def __init__(self, index: BlockIndex, asked: DataFrame, k: int, impact: bool):
        self.index, self.k, self.impact = index, k, impact
        order = Window.partitionBy("qid").orderBy(F.desc("g"), "token")  # a question's terms
        known = asked.filter("w > 0").join(index.terms.select("token", F.col("most" if impact else "most_tf").alias("most")).hint("merge"), "token").withColumn("g", F.col("w") * F.col("most"))
        known = known.withColumn("r", F.row_number().over(order)).withColumn("rest", F.sum("g").over(order.rowsBetween(0, Window.unboundedFollowing)))
        self.known = staged(known, "terms_asked")
        self.parts = -(-self.known.filter("r = 1").count() // GROUP)
        maxima = index.postings.select("token", "b", index.bound(impact).alias("top"))
        liked = self.known.filter(F.col("r") <= SEED_TERMS).join(maxima, "token").groupBy("qid", "b").agg(F.sum(F.col("w") * F.col("top")).alias("liking"))
        best = liked.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("liking"), "b"))).filter(F.col("n") <= SEED_BLOCKS)
        self.seeds = staged(best.select("qid", "b"), "seeds")
        first = staged(self._scored(self.seeds.withColumn("floor", F.lit(0.0))), "seed_scores")
        ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("raw")))).filter(F.col("n") <= k)
        floor = ranked.groupBy("qid").agg((F.when(F.count("*") == k, F.min("raw")).otherwise(F.lit(0.0)) - SLACK).alias("floor"))
        split = self.known.join(floor, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(-SLACK)))
        idle = F.sum(F.when(F.col("rest") < F.col("floor"), F.col("g")).otherwise(F.lit(0.0))).over(Window.partitionBy("qid"))
        essential = split.withColumn("idle", idle).filter(F.col("rest") >= F.col("floor"))
        bound = essential.join(maxima, "token").groupBy("qid", "b", "floor", "idle").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
        left = bound.filter(F.col("bound") + F.col("idle") >= F.col("floor")).select("qid", "b", "floor")
        self.others = staged(left.join(self.seeds.hint("merge"), ["qid", "b"], "left_anti"), "blocks_left")
        self.scores = first.unionByName(self._scored(self.others))

    @property
    def pairs(self) -> DataFrame:
        return self.seeds.unionByName(self.others.select("qid", "b"))

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """qid, chunk_id, raw: each block meets its questions in groups of some GROUP."""
        asked = self.known.groupBy("qid").agg(F.collect_list(F.struct("token", "w")).alias("t"))  # a question's terms
        met = pairs.hint("merge").join(asked.hint("merge"), "qid").select("b", F.struct("qid", "floor", F.col("t.token").alias("tokens"), F.col("t.w").alias("ws")).alias("q"), F.pmod(F.xxhash64("qid"), F.lit(max(self.parts, 1))).alias("part"))
        groups = met.groupBy("b", "part").agg(F.collect_list("q").alias("q")).select("b", F.col("q.qid").alias("qids"), F.col("q.floor").alias("floors"), F.col("q.tokens").alias("tokens"), F.col("q.ws").alias("ws"))
        rows = groups.hint("merge").join(self.index.blocks.select("b", "chunk_ids", "words").hint("merge"), "b").select("chunk_ids", "words", "qids", "floors", "tokens", "ws")
        kinds = rows.schema
        schema = StructType([StructField("qid", kinds["qids"].dataType.elementType), StructField("chunk_id", kinds["chunk_ids"].dataType.elementType), StructField("raw", DoubleType())])
        return rows.mapInArrow(_score_rows(self.index.avgdl if self.impact else None), schema)

    def best(self) -> DataFrame:
        """qid, chunk_id, score (6 decimals) of the k best of each question and all that equal the last of them."""
        rounded = self.scores.withColumn("score", F.round("raw", 6))
        return rounded.withColumn("_n", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("score")))).filter(F.col("_n") <= self.k).select("qid", "chunk_id", "score")
