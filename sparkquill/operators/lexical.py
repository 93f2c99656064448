"""Inverted-index scoring: postings, corpus statistics, BM25 and an OR full-text ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from sparkquill.functions import text as T
from sparkquill.functions.stem import lexemes
from sparkquill.operators.block_index import B, K1, BlockIndex
from sparkquill.staging import staged

EPSILON = 0.25


def tokens(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.select("chunk_id", T.tokenize(F.col(text)).alias("tokens"))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk_id, tokens -> chunk_id, token, tf of each row."""
    for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
        lists = batch.column(1)
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        cell, tf = np.unique(row * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, term = np.divmod(cell, max(len(coded.dictionary), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), coded.dictionary.take(pa.array(term)), pa.array(tf, pa.int64())], ["chunk_id", "token", "tf"])


def postings(tokenized: DataFrame, keyed: bool = False) -> DataFrame:
    """chunk_id, token, tf. Where each chunk_id is known to stand on one row (`keyed`), a row's own counts are the result and nothing is shuffled."""
    if keyed:
        schema = StructType([tokenized.schema["chunk_id"], StructField("token", StringType()), StructField("tf", LongType())])
        return tokenized.select("chunk_id", "tokens").mapInArrow(_count_rows, schema)
    return tokenized.select("chunk_id", F.explode("tokens").alias("token")).groupBy("chunk_id", "token").agg(F.count("*").alias("tf"))


def _freq_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tokens -> token, df among some FREQ_ROWS rows."""
    for batch in (whole.slice(lo, FREQ_ROWS) for whole in batches for lo in range(0, whole.num_rows, FREQ_ROWS)):
        lists = batch.column(0)
        coded = lists.flatten().dictionary_encode()
        term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cell = np.sort(np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy()) + term * len(lists))
        held = np.bincount(cell[np.diff(cell, prepend=-1) > 0] // max(len(lists), 1), minlength=len(coded.dictionary))
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(held, pa.int64())], ["token", "df"])
    T.give_back()


def doc_freq(tokenized: DataFrame) -> DataFrame:
    """token, df: counted in each task for some rows at a time, summed in one shuffle."""
    return tokenized.select("tokens").mapInArrow(_freq_rows, "token string, df long").groupBy("token").agg(F.sum("df").alias("df"))


def corpus_stats(tokenized: DataFrame) -> DataFrame:
    """One row: n_chunks, avgdl."""
    return tokenized.agg(F.count("*").alias("n_chunks"), F.avg(F.size("tokens")).alias("avgdl"))


def idf(freq: DataFrame, stats: DataFrame) -> DataFrame:
    """token, df, idf; a negative idf becomes EPSILON times the mean over the vocabulary (negative ones included)."""
    raw = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    each = freq.crossJoin(F.broadcast(stats)).select("token", "df", raw.alias("raw"))  # stats is one row
    mean = each.agg(F.avg("raw").alias("mean"))
    return each.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def rank_by(df: DataFrame, k: int, keys: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group; Spark keeps only k rows of a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def query_terms(questions: DataFrame, text: str = "question", tokenizer=T.tokenize) -> DataFrame:
    """qid, token, qtf: repeated terms count repeatedly."""
    return questions.select("qid", F.explode(tokenizer(F.col(text))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("qtf"))


class Store:
    """The chunks' words, cut once; all lexical retrievers over these chunks read them from here, and `keep` has columns that stay beside them. A block index is made
    of them where a search asks for one."""

    def __init__(self, chunks: DataFrame, text: str = "text", tokenizer=T.tokenize, keep: tuple[str, ...] = ()):
        self.tokenizer = tokenizer
        self.tokens = staged(chunks.select("chunk_id", *keep, tokenizer(F.coalesce(F.col(text), F.lit(""))).alias("tokens")), "tokens")

    @cached_property
    def index(self) -> BlockIndex:
        return BlockIndex.of(self.tokens)

    @cached_property
    def stats(self) -> DataFrame:
        return staged(corpus_stats(self.tokens), "corpus_stats")

    @cached_property
    def avgdl(self) -> float:
        return self.stats.first()["avgdl"] or 0.0

    @cached_property
    def freq(self) -> DataFrame:
        return staged(doc_freq(self.tokens), "terms")

    @cached_property
    def idf(self) -> DataFrame:
        return staged(idf(self.freq, self.stats), "idf")

    @cached_property
    def first_ids(self) -> DataFrame:
        """The chunks in order of chunk_id, for questions that match fewer than they ask for."""
        return self.tokens.select("chunk_id").orderBy("chunk_id")


def _store(chunks: DataFrame | Store, text: str) -> Store:
    return chunks if isinstance(chunks, Store) else Store(chunks, text)


#: Questions that a tile of scores is made for, and chunks of it: they bound a tile's memory.
QUERY_BLOCK = 4096
ROWS = 256
#: Pairs of a question and one of its best chunks that a task holds: they say how many blocks of questions a pass over all words answers.
KEPT = 1 << 19
#: Up to so many questions are answered by passes over all words: what a pass writes follows from its questions and tasks, while the block index writes the terms of
#: each question for each block that remains, which grows with questions times chunks. Where weights are negative no bound holds, and any number is answered by passes.
SCANNED = 1 << 24
#: Chunks whose words are looked up at a time, and products of a word with a question's weight that are summed up at a time.
CUT, PRODUCTS = 1024, 1 << 20
#: Terms of a block whose products are summed up as a matrix, those that most of its questions ask for, and the least share of its questions.
DENSE, DENSE_SHARE = 32, 1 / 256
#: A score this close to the least that counts may be rounded to it.
SLACK = 1e-6
FREQ_ROWS = 2048


def _cells(lists: pa.Array, terms: pa.Array, avgdl: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk, term and value (occurrences, or BM25's impact) of each distinct word of some chunks that is among the terms, in order of chunks."""
    n, length = len(lists), lists.value_lengths().fill_null(0).to_numpy()
    term = pc.index_in(lists.flatten(), value_set=terms)
    known = term.is_valid().to_numpy(zero_copy_only=False)
    cell = np.repeat(np.arange(n), length)[known] * len(terms) + term.drop_null().to_numpy().astype(np.int64)
    cell, tf = np.unique(cell, return_counts=True)
    row, col = np.divmod(cell, max(len(terms), 1))
    value = tf.astype(np.float64)
    if avgdl is not None:
        value = value * (K1 + 1) / (value + K1 * (1 - B + B * length[row] / (avgdl or 1.0)))
    return row, col, value


class _Block:
    """Some questions with their weights, and the best chunks that they have met so far.

    `starts` has for each term where the questions that ask for it, and their weights, begin. Within a batch chunks are places in order of chunk_id; `met` puts them to those of the batches before.
    """

    def __init__(self, lo: int, n: int, term: np.ndarray, n_terms: int, asker: np.ndarray, weight: np.ndarray, k: int, least: float, kind: pa.DataType):
        self.lo, self.n, self.k = lo, n, k
        self.starts, self.asker, self.weight = np.searchsorted(term, np.arange(n_terms + 1)), asker, weight
        many = np.diff(self.starts)
        often = np.argsort(-many, kind="stable")[:DENSE]
        often = often[many[often] > max(1, n * DENSE_SHARE)]
        self.slot = np.full(n_terms, -1)
        self.slot[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n))
        within = self.slot[term] >= 0
        self.dense[self.slot[term[within]], asker[within]] = weight[within]
        self.base = self.floor = self.least = np.full(n, least)  # what a score has to exceed: any, in this batch for what the batches before have, and by now
        self.q, self.raw, self.ids = np.zeros(0, np.int64), np.zeros(0), pa.array([], kind)
        self._start()

    def _start(self) -> None:
        self.new_q, self.new_at, self.new_raw, self.settled = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0

    def _kth(self, q: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """The rounded k-th best score of each question, -inf where there are fewer; pairs in order of question and rank."""
        last = np.flatnonzero(np.diff(q, append=-1))
        out = np.full(self.n, -np.inf)
        full = last[np.bincount(q, minlength=self.n)[q[last]] == self.k]
        out[q[full]] = np.round(raw[full], 6)
        return out

    def scores(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Scores of the chunks that the cells are of, a row for each chunk and a column for each question. Only the words that are asked for, with the questions that ask for them, are looked at."""
        slot = self.slot[col]
        common = slot >= 0
        held = np.zeros((rows, len(self.dense)))
        held[row[common], slot[common]] = value[common]
        score = (held @ self.dense).ravel()
        many = np.where(common, 0, self.starts[col + 1] - self.starts[col])
        asked = np.flatnonzero(many)
        row, col, value, many = row[asked], col[asked], value[asked], many[asked]
        ends = np.cumsum(many)
        lo = 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PRODUCTS, side="right")))
            each = many[lo:hi]
            at = np.arange(int(each.sum())) + np.repeat(self.starts[col[lo:hi]] - (np.cumsum(each) - each), each)
            score += np.bincount(np.repeat(row[lo:hi] * self.n, each) + self.asker[at], np.repeat(value[lo:hi], each) * self.weight[at], minlength=len(score))
            lo = hi
        return score.reshape(rows, self.n)

    def meet(self, score: np.ndarray, lo: int) -> None:
        """Scores of a batch's chunks from the place `lo` on: a chunk further on has a larger id, so that a tie is none of the best."""
        row, asked = np.nonzero(score > self.least)
        self.new_q, self.new_at, self.new_raw = np.append(self.new_q, asked), np.append(self.new_at, row + lo), np.append(self.new_raw, score[row, asked])
        if len(self.new_q) - self.settled > self.k * self.n:
            kept = _first_k(self.k, self.new_q, self.new_at, self.new_raw)
            self.new_q, self.new_at, self.new_raw = self.new_q[kept], self.new_at[kept], self.new_raw[kept]
            self.settled = len(self.new_q)
            self.least = np.maximum(self.floor, self._kth(self.new_q, self.new_raw))

    def met(self, ids: pa.Array) -> None:
        """The end of a batch with these chunk_ids in order: its best and those of the batches before."""
        if len(self.new_q):
            q, raw = np.append(self.q, self.new_q), np.append(self.raw, self.new_raw)
            found = pa.concat_arrays([self.ids, ids.take(pa.array(self.new_at))])
            place = np.empty(len(q), np.int64)
            place[pc.sort_indices(found).to_numpy()] = np.arange(len(q))
            kept = _first_k(self.k, q, place, raw)
            self.q, self.raw, self.ids = q[kept], raw[kept], found.take(pa.array(kept))
            self.floor = np.maximum(self.base, self._kth(self.q, self.raw) - SLACK)  # a tie in the next batch may have a smaller id
        self.least = self.floor
        self._start()


def _first_k(k: int, q: np.ndarray, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Which of the pairs (question, place) are among the k best of their question, in order of question and rank: rounded scores, then places."""
    order = np.lexsort((at, -np.round(raw, 6), q))
    starts = np.flatnonzero(np.diff(q[order], prepend=-1))
    return order[np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) < k]


def _best(asked, k: int, avgdl: float | None):
    """chunk_id, tokens -> the k best chunks among all of a task for each question: qid, chunk_id, raw score.

    asked: qids, terms, where the questions of each term begin, which questions these are, and their weights. With `avgdl` the scores are BM25's and all
    chunks compete, those without a match too; without it they are plain occurrences, and only chunks with a match appear. A tile of ROWS chunks and
    QUERY_BLOCK questions is scored at a time.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, terms, starts, asker, weight = asked.value
        blocks: list[_Block] = []
        for batch in batches:
            if not blocks:
                term = np.repeat(np.arange(len(terms)), np.diff(starts))
                for lo in range(0, len(qids), QUERY_BLOCK):
                    own = (asker >= lo) & (asker < lo + QUERY_BLOCK)
                    blocks.append(_Block(lo, min(QUERY_BLOCK, len(qids) - lo), term[own], len(terms), asker[own] - lo, weight[own], k, 0.0 if avgdl is None else -np.inf, batch.column(0).type))
            order = pc.sort_indices(batch.column(0))  # ties go to the smaller chunk_id
            for lo in range(0, batch.num_rows, CUT):
                lists = batch.column(1).take(order.slice(lo, CUT))
                row, col, value = _cells(lists, terms, avgdl)
                for first in range(0, len(lists), ROWS):
                    rows = min(ROWS, len(lists) - first)
                    a, b = np.searchsorted(row, [first, first + rows])
                    for block in blocks:
                        block.meet(block.scores(row[a:b] - first, col[a:b], value[a:b], rows), lo + first)
            for block in blocks:
                block.met(batch.column(0).take(order))
        for block in blocks:
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(block.q + block.lo)), block.ids, pa.array(block.raw)], ["qid", "chunk_id", "raw"])
        T.give_back()

    return rows


def _scan_topk(questions: DataFrame, asked: DataFrame, store: Store, k: int, avgdl: float | None) -> DataFrame:
    """The k best chunks for weighted terms (qid, token, w), which may be under 0. A pass over the words answers KEPT / k questions or a block of them; each of its tasks returns k rows
    for a question, so words are dealt to a few tasks for each core at most."""
    spark = questions.sparkSession
    ids = questions.select("qid").distinct()
    passes = -(-ids.count() // (max(1, KEPT // (k * QUERY_BLOCK)) * QUERY_BLOCK))
    place = F.pmod(F.xxhash64("qid"), F.lit(max(passes, 1)))
    if passes > 1:
        asked = staged(asked, "asked")
    schema = StructType([questions.schema["qid"], store.tokens.schema["chunk_id"], StructField("raw", DoubleType())])
    out = spark.createDataFrame([], StructType([*schema.fields[:2], StructField("score", DoubleType()), StructField("rank", IntegerType())]))
    for p in range(passes):
        qids = ids.filter(place == p).toArrow().column("qid").combine_chunks()  # the questions of a pass
        rows = asked.filter(place == p).select("qid", "token", "w").toArrow().combine_chunks()  # and their terms
        if not len(qids):
            continue
        terms = pc.unique(rows.column("token")).cast(pa.string())
        term, asker = (pc.index_in(rows.column(c).combine_chunks(), value_set=v).to_numpy(zero_copy_only=False).astype(np.int64) for c, v in (("token", terms), ("qid", qids)))
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(terms) + 1))
        sent = spark.sparkContext.broadcast((qids, terms, starts, asker[order], rows.column("w").to_numpy()[order]))
        words = store.tokens.select("chunk_id", "tokens").coalesce(2 * spark.sparkContext.defaultParallelism)
        found = words.mapInArrow(_best(sent, k, avgdl), schema).select("qid", "chunk_id", F.round("raw", 6).alias("score"))
        ranked = rank_by(found, k, ["qid"], F.desc("score"), F.col("chunk_id"))
        if passes == 1:
            return ranked
        out = out.unionByName(staged(ranked, "ranked"))  # a pass's questions are sent no longer than it takes
        sent.destroy()
    return out


def _few(questions: DataFrame) -> bool:
    return questions.select("qid").limit(SCANNED + 1).count() <= SCANNED


def bm25(questions: DataFrame, chunks: DataFrame | Store, k: int = 10, text: str = "text") -> DataFrame:
    """qid, chunk_id, score (6 decimals), rank: always min(k, chunks) rows, unmatched chunks at score 0 in order of chunk_id.

    A chunk_id that stands on several chunks is ranked once for each of them. Terms weigh less than 0 only where over half of the corpus's
    words stand in over half of its chunks: a match can then rank below no match, and the chunks are scanned.
    """
    store, terms = _store(chunks, text), query_terms(questions)
    asked = terms.join(store.idf.hint("merge"), "token").select("qid", "token", (F.col("qtf") * F.col("idf")).alias("w"))
    if _few(questions) or not store.idf.filter("idf < 0").isEmpty():
        return _scan_topk(questions, asked, store, k, store.avgdl)
    found = staged(store.index.search(asked, k).best().filter("score > 0"), "bm25")
    short = questions.select("qid").distinct().join(found.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").filter(F.coalesce("n", F.lit(0)) < k).select("qid")
    first = store.first_ids.limit(2 * k)  # k of them at least aren't among a question's matches, which are under k
    return rank_by(found.unionByName(_filled(short, first, found)), k, ["qid"], F.desc("score"), F.col("chunk_id"))


def _filled(short: DataFrame, first: DataFrame, found: DataFrame) -> DataFrame:
    """Each question of `short` with the chunks of `first` that it hasn't found, at score 0."""
    listed = first.agg(F.collect_list("chunk_id").alias("ids"))  # one row of 2 k chunk_ids
    each = short.crossJoin(F.broadcast(listed)).select("qid", F.explode("ids").alias("chunk_id"))
    return each.join(found.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").select("qid", "chunk_id", F.lit(0.0).alias("score"))


def full_text_or(questions: DataFrame, chunks: DataFrame | Store, k: int = 10, text: str = "text") -> DataFrame:
    """OR of the question's words, unstemmed: occurrences of query words in a chunk, no idf; chunks without any don't appear."""
    return full_text(questions, _store(chunks, text), k)


def lexeme_store(chunks: DataFrame, text: str = "text") -> Store:
    """A store of English lexemes: stems, without stop words."""
    return Store(chunks, text, lexemes)


def full_text(questions: DataFrame, store: Store, k: int = 10) -> DataFrame:
    """OR of the question's words, ranked by cover density: a cover of an OR query is one occurrence of one of its words, and all covers weigh the
    same, so the score is their number in the chunk. Words are the store's (`lexeme_store` has stems). Chunks without any, and questions without words, don't appear."""
    asked = query_terms(questions, tokenizer=store.tokenizer).select("qid", "token", F.lit(1.0).alias("w"))
    if _few(questions):
        return _scan_topk(questions, asked, store, k, None)
    found = store.index.search(asked, k, impact=False).best()
    return rank_by(found, k, ["qid"], F.desc("score"), F.col("chunk_id"))


def covers(places: list[list[int]]) -> list[tuple[int, int, int]]:
    """The minimal covers of an AND query, from the ordered places of each of its words: first place, last place, and the query's words between them. No cover holds another."""
    hits = sorted((p, w) for w, ps in enumerate(places) for p in ps)
    last, out = [-1] * len(places), []
    for i, (_, w) in enumerate(hits):
        last[w] = i
        first = min(last)
        if first >= 0 and (not out or first > out[-1][0]):
            out.append((first, i))
    return [(hits[a][0], hits[b][0], b - a + 1) for a, b in out]


def density(places: list[list[int]]) -> float:
    """Sum over the covers of 0.1 / (1 + other words inside)."""
    return sum(0.1 / (1 + (q - p) - (n - 1)) for p, q, n in covers(places))


def _density_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """qid, chunk_id, words of the question, words of the chunk -> qid, chunk_id, score."""
    for batch in batches:
        scores = []
        for asked, held in zip(batch.column(2).to_pylist(), batch.column(3)):
            held = held.values
            scores.append(density([pc.indices_nonzero(pc.equal(held, w)).to_pylist() for w in asked]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["qid", "chunk_id", "score"])


def full_text_and(questions: DataFrame, store: Store, k: int = 10) -> DataFrame:
    """AND of the question's words: chunks that hold all of them, by cover density (9 decimals), ties by chunk_id. Places are counted in the store's words.

    The blocks of the question's rarest word alone are read; chunks of it that hold every other word, too, get their words' places.
    """
    terms = query_terms(questions, tokenizer=store.tokenizer).join(store.freq, "token", "left")
    asked = staged(terms.groupBy("qid").agg(F.sort_array(F.collect_list("token")).alias("words"), F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("rarest")), "asked")
    held = store.index.blocks.select("b", "chunk_ids", F.col("words").alias("texts"))
    near = asked.join(store.index.postings.select(F.col("token").alias("rarest"), "b"), "rarest").join(held, "b").select("qid", "words", F.explode(F.arrays_zip("chunk_ids", "texts")).alias("c"))
    near = near.select("qid", "words", F.col("c.chunk_ids").alias("chunk_id"), F.col("c.texts").alias("tokens"))
    full = near.filter(F.size(F.array_except("words", "tokens")) == 0).select("qid", "chunk_id", "words", "tokens")
    schema = StructType([questions.schema["qid"], store.tokens.schema["chunk_id"], StructField("score", DoubleType())])
    return rank_by(full.mapInArrow(_density_rows, schema).select("qid", "chunk_id", F.round("score", 9).alias("score")), k, ["qid"], F.desc("score"), F.col("chunk_id"))
