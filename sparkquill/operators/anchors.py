"""Anchors: few hashes of a text, of which every text that contains a long enough piece of it has the same ones.

A level is a length of window in characters. The anchor of a window is the smallest hash of its runs of `k` characters; neighbouring windows mostly share
theirs, so a text has about 2 / (w + 1) anchors a character, w runs to a window. A text that contains a piece of at least a window holds all of the
piece's windows, and so all of its anchors: an equi-join on anchors finds every container of a piece, and what it finds besides is told apart by the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Length of a level's windows -> characters of a run. From 5 down a window is one run: its distinct values are few, 36 to the power of its length.
LEVELS = {40: 12, 20: 10, 10: 8, 5: 5, 2: 2, 1: 1}
STEP = 1 << 18  # windows hashed at a time, whatever the length of a text
ROWS = 1024  # texts held at a time, whatever the size of a batch
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def level_of(text: Column) -> Column:
    """The longest level whose window fits into the text; null for an empty text."""
    level = F.lit(None).cast("int")
    for size in sorted(LEVELS):
        level = F.when(F.length(text) >= size, F.lit(size)).otherwise(level)
    return level


def window_minima(chars: np.ndarray, size: int) -> np.ndarray:
    """The anchor of each window of `size` bytes, as many as there are windows."""
    k = LEVELS[size]
    w, n = size - k + 1, len(chars) - k + 1
    if len(chars) < size:
        return np.empty(0, np.int64)
    h = np.full(n, np.uint64(size))
    for j in range(k):
        h = h * _BASE + chars[j : n + j]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h ^= h >> np.uint64(29)
    span = 1
    while span * 2 <= w:  # minima of 1, 2, 4, ... runs, then two that overlap
        h, span = np.minimum(h[:-span], h[span:]), span * 2
    if span < w:
        h = np.minimum(h[: len(h) - (w - span)], h[w - span :])
    return h.view(np.int64)


def _batch_anchors(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their anchors, each once for a step at most."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    chars = np.frombuffer(b"".join(texts), np.uint8)
    rows, found = [], []
    for at in range(0, len(chars), STEP):
        minima = window_minima(chars[at : at + STEP + size - 1], size)
        start = np.arange(at, at + len(minima))
        row = np.searchsorted(ends, start, side="right")
        inside = start + size <= ends[row]  # a window that runs into the next text is none
        row, minima = row[inside], minima[inside]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (minima[1:] != minima[:-1])
        pairs = np.unique(np.stack([row[fresh], minima[fresh]]), axis=1)
        rows.append(pairs[0])
        found.append(pairs[1])
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def anchored(df: DataFrame, text: str, levels: list[int], level: str | None = None) -> DataFrame:
    """One row for each anchor of a text of ASCII characters, at each of the levels or at the one in the column `level`: the other columns, and `anchor`.

    A null text, and one shorter than the window, have none. No row depends on another, so nothing is shuffled.
    """
    kept = [c for c in df.columns if c != text]
    schema = StructType([df.schema[c] for c in kept] + [StructField("anchor", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            texts = batch.column(text).to_pylist()
            own = np.array(batch.column(level).to_pylist(), object) if level else None
            for size in levels:
                wanted = np.arange(len(texts)) if own is None else np.flatnonzero(own == size)
                row, anchor = _batch_anchors([(texts[i] or "").encode("ascii") for i in wanted], size)
                if len(row):
                    took = pa.array(wanted[row])
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(took) for c in kept], pa.array(anchor)], names=[*kept, "anchor"])

    return df.mapInArrow(run, schema)
