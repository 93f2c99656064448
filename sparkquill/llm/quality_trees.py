"""Operator 10: a quality classifier of histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in numpy over Arrow batches. The trees are fitted to the statistics of at most
SAMPLE labelled documents (those with the smallest hash of their doc_id; of rows with one doc_id the one with the smallest statistics), on histograms of BINS bins, depth by depth,
with the logistic loss. The fitted trees are flattened into arrays, one row for each tree, and all documents of a batch
walk down one level of all trees at a time. Scoring is one pass over the texts without a shuffle.

A null text counts as empty; texts without words have zeros everywhere and get a score like any other. Several labels of one
doc_id count by their mean, rounded. Without labels of both kinds every score is the share of label 1, or 0.5. Scores
lie in 0 to 1. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkquill.llm._arrays import SPACE_SPLIT, Words, chunks, list_column, windows

SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, L2, LEAST_LEAF = 64, 80, 5, 0.12, 4.0, 20

FEATURES = [
    "words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "repeated_runs", "repeated_lines", "lines", "words_per_line",
    "upper", "digits", "symbols", "pipes", "marks", "stops", "commas", "quotes", "past_ascii", "spaces", "initial_upper", "symbol_ended", "bang_ended", "mean_gap",
]


def _by_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document: distinct values, the count of the most frequent one, and occurrences of values that occur again."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count, owner = np.diff(np.append(at, len(h))), doc[at]
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    return np.bincount(owner, minlength=n).astype(float), top, np.bincount(owner, weights=np.where(count > 1, count, 0), minlength=n)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT, _SYMBOL, _MARK = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("#*$%&<>@^~_=+\\/{}[]"), _class("!?")
#: Lines: everything but \n belongs to one; NUL maps to a byte that UTF-8 never uses.
_LINES = np.arange(256).astype(np.uint8)
_LINES[0], _LINES[10] = 0xFF, 0


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics (float32, FEATURES) of each text."""
    n = len(offsets) - 1
    words = Words(raw, offsets, SPACE_SPLIT)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    count = words.count.astype(float)
    some = np.maximum(count, 1)
    length = (words.end - words.start).astype(float)
    per_word = lambda flag: np.bincount(words.doc, weights=flag, minlength=n) / some
    distinct, top, _ = _distinct(words.hash, words.doc, n)
    run, _, run_doc = windows(words, 3)
    _, _, again = _distinct(run, run_doc, n)
    lines = Words(raw, offsets, _LINES)
    kinds, _, _ = _distinct(lines.hash, lines.doc, n)
    n_lines = lines.count.astype(float)
    share = lambda flag: _by_doc(flag, offsets) / size
    first, last = (raw[words.start], raw[words.end - 1]) if len(words.start) else (np.zeros(0, np.uint8), np.zeros(0, np.uint8))
    out = [
        np.log1p(count), np.bincount(words.doc, weights=length, minlength=n) / some, per_word(length > 12), per_word(length <= 3), distinct / some, top / some,
        again / some, (n_lines - kinds) / np.maximum(n_lines, 1), np.log1p(n_lines), np.log1p(count / np.maximum(n_lines, 1)),
        share(_UPPER[raw]), share(_DIGIT[raw]), share(_SYMBOL[raw]), share(raw == ord("|")), share(_MARK[raw]), share(raw == ord(".")), share(raw == ord(",")),
        share((raw == ord('"')) | (raw == ord("'"))), share(raw >= 0x80), share((raw == 32) | (raw == 10)), per_word(_UPPER[first]), per_word(_SYMBOL[last]), per_word(_MARK[last]),
        size / some,
    ]
    out = np.stack(out, axis=1).astype(np.float32)
    out[words.count == 0] = 0
    return out


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, offsets in chunks(batches):
        x = statistics(raw, offsets)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), list_column(x.ravel(), np.full(len(x), x.shape[1]), pa.float32())], ["doc_id", "y", "x"])


def fit(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Trees as arrays: feature and threshold of the inner nodes (1 is the root, children 2k and 2k + 1), leaf values, and the base score."""
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    base = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return {"feature": np.zeros((0, 1 << DEPTH), np.int16), "threshold": np.zeros((0, 1 << DEPTH), np.float32), "leaf": np.zeros((0, 1 << DEPTH)), "base": np.array(base)}
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    n_f = x.shape[1]
    flat = binned + np.arange(n_f) * BINS
    raw = np.full(len(y), base)
    feature, threshold, leaf = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        f_t, t_t = np.zeros(1 << DEPTH, np.int16), np.full(1 << DEPTH, np.inf, np.float32)
        for depth in range(DEPTH):
            width = 1 << depth
            cell = (node[:, None] * (n_f * BINS) + flat).ravel()
            hist = [np.bincount(cell, weights=np.repeat(w, n_f), minlength=width * n_f * BINS).reshape(width, n_f, BINS).cumsum(axis=2) for w in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (gt, ht, nt) = hist, [a[:, :, -1:] for a in hist]
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            k, b = best // BINS, best % BINS
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            for i in range(width):
                if good[i] and b[i] < len(edges[k[i]]):
                    f_t[width + i], t_t[width + i] = k[i], edges[k[i]][b[i]]
            go = x[np.arange(len(y)), f_t[width + node]] > t_t[width + node]
            node = node * 2 + go
        gl, hl = np.bincount(node, weights=g, minlength=1 << DEPTH), np.bincount(node, weights=h, minlength=1 << DEPTH)
        value = RATE * gl / (hl + L2)
        raw += value[node]
        feature.append(f_t)
        threshold.append(t_t)
        leaf.append(value)
    return {"feature": np.stack(feature), "threshold": np.stack(threshold), "leaf": np.stack(leaf), "base": np.array(base)}


def score(trees: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), float(trees["base"]))
    n_trees = len(trees["feature"])
    tree, row = np.arange(n_trees), np.arange(len(x))[:, None]
    if n_trees and len(x):
        node = np.ones((len(x), n_trees), dtype=np.int64)
        for _ in range(DEPTH):
            node = node * 2 + (x[row, trees["feature"][tree, node]] > trees["threshold"][tree, node])
        total += trees["leaf"][tree, node - (1 << DEPTH)].sum(axis=1)
    return 1 / (1 + np.exp(-total))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _scorer(trees):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in chunks(batches):
            found = score(trees.value, statistics(raw, offsets))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "_score"])

    return rows


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, remainder: int = 2, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Trees fitted to the statistics of at most `sample` labelled documents; labels of held-out rows are never read."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg(label)).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # its size bounds the broadcast and what comes back
    x = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").mapInArrow(_statistics_rows, "doc_id long, y double, x array<float>")
    rows = x.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toArrow()  # `sample` rows at most
    flat = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, len(FEATURES)), np.float32)
    return fit(flat, rows.column("y").to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, remainder: int = 2, sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id by default) of every document with held_out, score and predicted, in one pass over the texts."""
    keep = keep or ["doc_id"]
    trees = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, label, modulus, remainder, sample))
    chosen = docs.select("text", *[c for c in dict.fromkeys(["doc_id", *keep]) if c != "text"])
    scored = chosen.mapInArrow(_scorer(trees), StructType([*chosen.schema.fields, StructField("_score", DoubleType())]))
    return scored.select(
        *keep, held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= 0.7, 1).otherwise(0).alias("predicted")
    )
