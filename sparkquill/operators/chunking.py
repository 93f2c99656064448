"""Overlapping word windows over texts and over sections of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sparkquill.functions import text as T

SIZE, OVERLAP = 300, 50
#: Texts that are cut at a time, whatever the size of a batch.
ROWS = 128


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """First words of the windows: one for a short text, none for an empty one."""
    step = max(1, size - overlap)
    last = F.when(n > size, F.floor((n - overlap - 1) / step)).otherwise(F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def _windows(size: int, overlap: int):
    """The columns of a batch, the last of them normalized texts -> the others, the number of each window, and its text: bytes between two of the text's spaces."""
    step = max(1, size - overlap)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            *kept, texts = batch.columns
            data, at = T.utf8(texts)
            space = np.flatnonzero(data == 32)
            first = np.searchsorted(space, at)  # of all spaces, a text's first
            n = np.where(at[1:] > at[:-1], np.diff(first) + 1, 0)
            many = np.where(n > 0, np.where(n > size, (n - overlap - 1) // step, 0) + 1, 0).clip(0)
            row = np.repeat(np.arange(len(n)), many)
            number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            lo, hi = number * step, np.minimum(number * step + size, n[row])  # words
            space = np.append(space, len(data))
            begin = np.where(lo > 0, space[first[row] + lo - 1] + 1, at[row])
            end = np.where(hi < n[row], space[first[row] + hi - 1], at[row + 1])
            whole = data.tobytes()
            cut = pa.array([whole[b:e] for b, e in zip(begin.tolist(), end.tolist())], pa.binary()).cast(pa.string())
            took = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[c.take(took) for c in kept], pa.array(number, pa.int32()), cut], names=[*batch.schema.names[:-1], "n", "text"])
        T.give_back()

    return rows


def chunk_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """`key`, n, chunk_id (key and number, padded), text and the columns `keep` for every window of whole texts. A row's windows need no shuffle."""
    held = docs.select(key, *keep, T.normalize(F.col(text)).alias("_t"))
    schema = StructType([*held.schema.fields[:-1], StructField("n", IntegerType()), StructField("text", StringType())])
    return held.mapInArrow(_windows(size, overlap), schema).select(key, *keep, "n", F.format_string("%010d:%03d", F.col(key).cast("long"), F.col("n")).alias("chunk_id"), "text")
