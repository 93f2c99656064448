"""Operator 7: benchmark decontamination with an FM-index for each shard of the documents.

A shard is a run of whole documents of one partition, with about SHARD_BYTES of text. Its words become numbers, each
document ends in a separator of its own, and the suffix array (prefix doubling over the groups that are still open)
gives the Burrows-Wheeler transform, held as a wavelet matrix. The windows of the benchmark items, ten words or the
whole of a shorter item, are searched backwards through its ranks, all at once; occurrences are located by walking to
the next sampled suffix position, and overlapping occurrences are merged into removal spans.

The benchmark is the stated query set: its distinct windows are cut into blocks of about BLOCK_WINDOWS (some 100 bytes each,
which bounds what is broadcast), and one pass over the documents searches for one block. One block holds some hundred thousand items; only a larger benchmark
takes further passes, each of which writes what it found before the next block is broadcast. Tasks report windows by their hash; items join them in Spark.

Words: A-Z lower-cased, runs of digits, ASCII letters and all characters past U+007F, compared by a 64-bit hash. Null
and empty texts have no words; items without words have no windows; repeated items count each under their item_id, and a null item_id has no name but hits.
Empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkquill.llm._arrays import ALNUM_SPLIT, Words, chunks, list_column
from sparkquill.llm._stage import drop_staged, salted_lookup, staged

WINDOW = 10
SHARD_BYTES = 6 << 20
SAMPLE = 32
BLOCK_WINDOWS = 1_000_000


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; the last symbol must be the only one of its kind."""
    n = len(text)
    sa = np.argsort(text, kind="stable")
    starts = np.ones(n, dtype=bool)
    starts[1:] = text[sa[1:]] != text[sa[:-1]]
    at = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = at
    single = starts & np.append(starts[1:], True)
    live, h = sa[~single], 1
    while len(live):
        head = rank[live]
        key = head * n + rank[np.minimum(live + h, n - 1)]
        order = np.argsort(key, kind="stable")
        live, head, key = live[order], head[order], key[order]
        index = np.arange(len(live))
        new_head = np.ones(len(live), dtype=bool)
        new_head[1:] = head[1:] != head[:-1]
        slot = head + index - np.maximum.accumulate(np.where(new_head, index, 0))
        new_key = np.ones(len(live), dtype=bool)
        new_key[1:] = key[1:] != key[:-1]
        sa[slot] = live
        rank[live] = slot[np.maximum.accumulate(np.where(new_key, index, 0))]
        live = live[~(new_key & np.append(new_key[1:], True))]
        h *= 2
    return sa


class Wavelet:
    """Wavelet matrix: rank and access over an array of small integers, for many positions at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        n = len(values)
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8 + 8), dtype="<u8")
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(n - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & below)

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbols before `at` end after all levels; differences of two places are counts of the symbol."""
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each position, and its place."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for level in range(self.bits):
            one = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
            symbol = symbol * 2 + one
        return symbol, at


class FMIndex:
    """FM-index over the words of a shard's documents; symbol 0 is any separator."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        n_docs, n = len(counts), len(hashes) + len(counts)
        ends = np.cumsum(counts) + np.arange(n_docs)  # of the separators
        self.starts = ends - counts
        symbols = np.zeros(n, dtype=np.int64)
        word_at = np.ones(n, dtype=bool)
        word_at[ends] = False
        symbols[word_at] = ids + 1
        order = symbols + (n_docs - 1)
        order[ends] = np.arange(n_docs)
        sa = suffix_array(order)
        self.n = n
        self.bwt = Wavelet(symbols[sa - 1], max(1, int(len(self.vocabulary)).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.vocabulary) + 1))])
        # places of the symbols' first rows in the wavelet matrix
        self.base = self.bwt.place(np.arange(len(self.vocabulary) + 1), np.zeros(len(self.vocabulary) + 1, dtype=np.int64))
        marked = (sa % SAMPLE == 0) | (symbols[sa - 1] == 0)
        self.marked, self.sampled = marked, sa[marked]
        self.mark_rank = np.cumsum(marked) - 1

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all occurrences of the windows (rows of word hashes, right-aligned), and the window of each."""
        window = np.arange(len(windows))
        size = len(self.vocabulary)
        if not size or not len(windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.searchsorted(self.vocabulary, windows)
        ok = (known < size) & (self.vocabulary[np.minimum(known, size - 1)] == windows)
        needed = np.arange(windows.shape[1])[None, :] >= windows.shape[1] - lengths[:, None]
        window = window[(ok | ~needed).all(axis=1)]
        lo, hi = np.zeros(len(window), dtype=np.int64), np.full(len(window), self.n, dtype=np.int64)
        for k in range(windows.shape[1]):
            go = lengths[window] > k
            symbol = known[window, windows.shape[1] - 1 - k] + 1
            symbol = np.where(go, symbol, 0)
            base = self.base[symbol]
            lo2 = self.first[symbol] + self.bwt.place(symbol, lo) - base
            hi2 = self.first[symbol] + self.bwt.place(symbol, hi) - base
            lo, hi = np.where(go, lo2, lo), np.where(go, hi2, hi)
            live = hi > lo
            window, lo, hi = window[live], lo[live], hi[live]
        count = hi - lo
        row = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else lo, count) + np.arange(count.sum())
        return self.locate(row), np.repeat(window, count)

    def locate(self, row: np.ndarray) -> np.ndarray:
        walked = np.zeros(len(row), dtype=np.int64)
        open_ = np.flatnonzero(~self.marked[row])
        row = row.copy()
        while len(open_):
            symbol, place = self.bwt.step(row[open_])
            row[open_] = self.first[symbol] + place - self.base[symbol]
            walked[open_] += 1
            open_ = open_[~self.marked[row[open_]]]
        return self.sampled[self.mark_rank[row]] + walked


def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, text -> item_id, words (the hashes of one window, 8 bytes each)."""
    for batch, raw, offsets in chunks(batches):
        words = Words(raw, offsets, ALNUM_SPLIT)
        ids, rows, parts = batch.column(0), [], []
        for i in range(batch.num_rows):
            h = words.hash[words.bounds[i] : words.bounds[i + 1]]
            for k in range(max(min(len(h), 1), len(h) - WINDOW + 1)):
                rows.append(i)
                parts.append(h[k : k + WINDOW].tobytes())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(parts, pa.binary())], ["item_id", "words"])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, words, window (a 64-bit hash of the words): the distinct windows of each item."""
    found = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(item_windows, "item_id string, words binary").distinct()
    return staged(found.withColumn("window", F.xxhash64("words")), "windows")


def _block(windows: DataFrame, block: int, blocks: int) -> Broadcast | None:
    """One block of the distinct windows: (right-aligned word hashes, lengths, names of the windows)."""
    rows = windows.filter(F.pmod("window", F.lit(blocks)) == block).select("window", "words").distinct().toArrow()  # about BLOCK_WINDOWS rows
    if not rows.num_rows:
        return None
    words = rows.column("words").to_pylist()
    lengths = np.array([len(w) // 8 for w in words], dtype=np.int64)
    hashes = np.frombuffer(b"".join(w.rjust(8 * WINDOW, b"\0") for w in words), dtype=np.uint64).reshape(-1, WINDOW)
    return windows.sparkSession.sparkContext.broadcast((hashes, lengths, rows.column("window").to_numpy()))


def _searcher(block: Broadcast | None):
    """text, any columns, _starts, _ends, _windows (of the blocks before) -> the same columns with n_words and what this block adds."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in chunks(batches, limit=SHARD_BYTES):
            words = Words(raw, offsets, ALNUM_SPLIT)
            n = batch.num_rows
            first = np.cumsum(words.count) + np.arange(n) - words.count  # of each document, with a separator after the one before
            edge = np.zeros(len(words.hash) + n + 1, dtype=np.int64)
            names = len(batch.schema.names) - 4
            old = [batch.column(names + 1 + k) for k in range(3)]
            doc = np.repeat(np.arange(n), [len(x) for x in old[0]])
            for sign, column in ((1, old[0]), (-1, old[1])):
                np.add.at(edge, column.flatten().to_numpy() + first[doc], sign)
            met: list[np.ndarray] = []
            if block is not None:
                hashes, lengths, window_names = block.value
                index = FMIndex(words.hash, words.count)
                at, window = index.search(hashes, lengths)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + lengths[window], -1)
                doc = np.searchsorted(index.starts, at, side="right") - 1
                pairs = np.unique(np.stack([doc, window]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
                met = np.split(window_names[pairs[1]], np.searchsorted(pairs[0], np.arange(1, n)))
            found = [[*(old[2][i].as_py() or ()), *(met[i].tolist() if met else ())] for i in range(n)]
            hit = np.cumsum(edge[:-1]) > 0
            before = np.concatenate([[0], np.cumsum(hit)])
            n_hit = before[first + words.count] - before[first]
            flip = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            begin, end = np.flatnonzero(flip == 1), np.flatnonzero(flip == -1)
            doc = np.searchsorted(first, begin, side="right") - 1
            per_doc = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, dtype=np.int64)
            base = first[doc] if len(doc) else doc
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:names], pa.array(words.count, pa.int64()), list_column(begin - base, per_doc, pa.int64()),
                    list_column(end - base, per_doc, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(n_hit, pa.int64()),
                ],
                [*batch.schema.names[:names], "_n", "_starts", "_ends", "_windows", "_hit"],
            )

    return search


def _search(docs: DataFrame, windows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with _n, _hit, _starts, _ends and the hashes of the windows met, after a pass for each block of windows."""
    blocks = max(1, -(-windows.select("window").distinct().count() // BLOCK_WINDOWS))
    none = F.array().cast("array<long>")
    chosen = docs.select("text", *[c for c in keep if c != "text"])
    width = len(chosen.columns)
    added = StructType.fromDDL("_n long, _starts array<long>, _ends array<long>, _windows array<long>, _hit long")
    schema = StructType(chosen.schema.fields + added.fields)
    found, held = chosen.select("*", F.lit(0).cast("long").alias("_n"), none.alias("_starts"), none.alias("_ends"), none.alias("_windows")), None
    for k in range(blocks):
        block = _block(windows, k, blocks)
        if held is not None and block is None:
            continue
        found = found.mapInArrow(_searcher(block), schema)
        if k + 1 < blocks:  # the block is done with before the next one is sent
            old, held = held, staged(found, "searched")
            found = held.select(*held.columns[:width], "_n", "_starts", "_ends", "_windows")
            if block is not None:
                block.unpersist()
            if old is not None:
                drop_staged(old)
    return found


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id by default) of every document, with n_words, n_hit and the merged removal spans as word numbers
    (span_starts, span_ends excluded). One pass, without a shuffle or a join, for a benchmark of one block."""
    keep = keep or ["doc_id"]
    found = _search(docs, benchmark_windows(benchmark), keep)
    return found.select(*keep, F.col("_n").alias("n_words"), F.col("_hit").alias("n_hit"), F.col("_starts").alias("span_starts"), F.col("_ends").alias("span_ends"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`hits`, and item_ids: the sorted names of the items with a window in the document. Windows are met by hash, hot ones salted."""
    keep = keep or ["doc_id"]
    windows = benchmark_windows(benchmark)
    found = staged(_search(docs, windows, keep).withColumn("_row", F.monotonically_increasing_id()), "found")
    each = found.filter(F.size("_windows") > 0).select("_row", F.explode("_windows").alias("window"))
    counted = each.groupBy("window").agg(F.count("*").alias("_n"))
    items = windows.filter("item_id IS NOT NULL").groupBy("window").agg(F.collect_set("item_id").alias("items")).join(counted, "window")
    met = salted_lookup(each, items, "window", "_row", "_n")
    named = met.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))  # one document's items
    out = found.join(named, "_row", "left")
    empty = F.array().cast("array<string>")
    return out.select(
        *keep, F.col("_n").alias("n_words"), F.col("_hit").alias("n_hit"), F.col("_starts").alias("span_starts"), F.col("_ends").alias("span_ends"), F.coalesce("item_ids", empty).alias("item_ids"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
