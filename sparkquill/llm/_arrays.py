"""Numpy helpers over Arrow text columns: words, their hashes and windows, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
SEGMENT_BYTES = 1 << 20

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def _space(byte: int) -> bool:
    return byte == 0x20 or 0x09 <= byte <= 0x0D


def _alnum(byte: int) -> bool:
    return 0x30 <= byte <= 0x39 or 0x41 <= byte <= 0x5A or 0x61 <= byte <= 0x7A or byte >= 0x80


def byte_table(is_word) -> np.ndarray:
    """Maps a byte to its lower-case byte (A-Z only), or to 0 where it separates words."""
    return np.array([(b + 32 if 0x41 <= b <= 0x5A else b) if is_word(b) else 0 for b in range(256)], dtype=np.uint8)


#: Words are runs of anything but space and 0x09-0x0D. NUL maps to 0xFF, a byte that UTF-8 never uses.
SPACE_SPLIT = byte_table(lambda b: not _space(b))
SPACE_SPLIT[0] = 0xFF
#: Words are runs of digits, ASCII letters and all characters past 0x7F.
ALNUM_SPLIT = byte_table(_alnum)

_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, size=256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SEGMENT_BYTES + 4096)
        for name, base in (("up", int(_MULT)), ("down", pow(int(_MULT), -1, 1 << 64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts record batches into runs of rows with at most `limit` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start), raw[off[start] : off[stop]], off[start : stop + 1] - off[start]
            start = stop


class Words:
    """The words of some texts: byte ranges, 64-bit hashes, and the range of words of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        mapped = table[raw]
        inside = mapped != 0
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        cut = offsets[:-1][offsets[:-1] < len(raw)]
        before[cut] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside) + 1, dtype=bool)
        after[:-1] = inside & before  # the next byte goes on with the same word
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.hash = np.empty(len(self.start), dtype=np.uint64)
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + SEGMENT_BYTES, side="right")))
            lo, hi = self.start[i], self.end[j - 1]
            up, down = powers(int(hi - lo))
            total = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[mapped[lo:hi]] * up[: hi - lo], out=total[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            self.hash[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
            i = j


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and text of every run of `size` words; a text with fewer words, but not none, is one run."""
    n = len(words.hash)
    first = np.arange(max(0, n - size + 1))
    first = first[words.doc[first] == words.doc[first + size - 1]] if len(first) else first
    h = np.zeros(len(first), dtype=np.uint64)
    for k in range(size):
        h = h * _U(0xC2B2AE3D27D4EB4F) + words.hash[first + k]
    h = mix(h + _U(size))
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = words.count[short] > k
            extra[has] = extra[has] * _U(0xC2B2AE3D27D4EB4F) + words.hash[words.bounds[short[has]] + k]
        extra = mix(extra + words.count[short].astype(np.uint64))
        at = words.bounds[short]
        first, h = np.concatenate([first, at]), np.concatenate([h, extra])
        order = np.argsort(first, kind="stable")
        first, h = first[order], h[order]
    return h, first, words.doc[first] if len(first) else first


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
