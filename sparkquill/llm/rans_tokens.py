"""Operator 3: token ids in frames of a static range asymmetric numeral system (rANS).

Every document's ids (its end id last) are written in ascending order of doc_id. One table of symbol frequencies, counted
over all tokens and scaled to 2**PRECISION, is shared by all frames. A frame holds whole documents with about FRAME_TOKENS
ids and is decoded on its own: LANES interleaved states share one stream of 32-bit words; every CHECKPOINT steps the
states and the place in the stream are noted, so that the pieces between checkpoints are decoded side by side; a CRC-32
closes it. A frame that a long document makes longer than twice FRAME_TOKENS is a sequence of such blocks, so what is coded at a time (SIDE_BY_SIDE blocks)
has a size that no text changes; long texts are split into words part by part, too. A token dataset is a folder with `frames` (one row for each frame: shard, frame, first_token within the
shard, doc_ids, lengths, payload) and `table` (symbol, frequency, end_id, ...), both Parquet, so any store that
Spark reads will do.

Ids have 16 bits; a vocabulary with larger ones raises an error. Null texts are empty and have the end id alone. A null
doc_id sorts first. Rows with equal doc_id keep an order by their ids. An empty table gives an empty dataset. A frame whose checksum differs raises an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquill.llm._arrays import chunks
from sparkquill.llm._stage import drop_staged, new_path, staged
from sparkquill.llm._tokens import PART_BYTES, Pieces, load_tokenizer, parts_of, shared_word_ids, sums_by, tokenizer_path

PRECISION, LANES, CHECKPOINT, FRAME_TOKENS = 20, 32, 512, 1 << 16
#: Frames that are coded together: numpy's cost for each step is shared by them.
SIDE_BY_SIDE = 32
END_ID = 1
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
_LOW = np.uint64(1 << 31)
_U = np.uint64
_HEAD = struct.Struct("<4sIIII")


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**PRECISION, at least 1 for every symbol that occurs."""
    total, m = int(counts.sum()), 1 << PRECISION
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    f = np.where(counts > 0, np.maximum(1, counts.astype(object) * m // total), 0).astype(np.int64)
    while (rest := m - int(f.sum())) != 0:  # the most frequent symbols take what rounding left
        order = np.argsort(-f, kind="stable")
        if rest > 0:
            f[order[0]] += rest
        else:
            give = np.minimum(f[order] // 2, -rest)
            give = np.minimum(give, np.maximum(0, -rest - np.concatenate([[0], np.cumsum(give)[:-1]])))
            f[order] -= give
    return f


def encode_frames(frames: list[np.ndarray], freq: np.ndarray) -> list[bytes]:
    """A payload for each array of symbols: its blocks, one after the other. SIDE_BY_SIDE blocks go through the steps together."""
    blocks, owner = [], []
    for i, x in enumerate(frames):
        cuts = range(0, len(x), FRAME_TOKENS) if len(x) > 2 * FRAME_TOKENS else [0]
        blocks += [x[a : a + FRAME_TOKENS] if len(cuts) > 1 else x for a in cuts]
        owner += [i] * len(cuts)
    out: list[list[bytes]] = [[] for _ in frames]
    for lo in range(0, len(blocks), SIDE_BY_SIDE):
        for i, payload in zip(owner[lo:], _encode_blocks(blocks[lo : lo + SIDE_BY_SIDE], freq)):
            out[i].append(payload)
    return [b"".join(x) for x in out]


def _encode_blocks(frames: list[np.ndarray], freq: np.ndarray) -> list[bytes]:
    cum = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint64)
    f64 = freq.astype(np.uint64)
    n = np.array([len(x) for x in frames])
    steps = -(-n // LANES)
    most = int(steps.max(initial=0))
    tokens = np.zeros((len(frames), most * LANES), dtype=np.int64)
    for i, x in enumerate(frames):
        tokens[i, : len(x)] = x
    tokens = tokens.reshape(len(frames), most, LANES)
    state = np.full((len(frames), LANES), _LOW, dtype=np.uint64)
    words = np.zeros((most, len(frames), LANES), dtype=np.uint32)
    wrote = np.zeros((most, len(frames), LANES), dtype=bool)
    marks: list[list[np.ndarray]] = [[] for _ in frames]
    lane = np.arange(LANES)
    for s in range(most - 1, -1, -1):
        live = s * LANES + lane[None, :] < n[:, None]
        sym = tokens[:, s]
        f = np.where(live, f64[sym], _U(1))
        full = live & (state >= f << _U(31 - PRECISION + 32))
        words[s][full] = (state[full] & _U(0xFFFFFFFF)).astype(np.uint32)
        wrote[s] = full
        state = np.where(full, state >> _U(32), state)
        quotient = state // f
        state = np.where(live, (quotient << _U(PRECISION)) + (state - quotient * f) + cum[sym], state)
        if s % CHECKPOINT == 0:
            for i in np.flatnonzero(steps > s):
                marks[i].append(state[i].copy())
    out = []
    for i in range(len(frames)):
        w, k = words[: steps[i], i], wrote[: steps[i], i]
        per_step = np.concatenate([[0], np.cumsum(k.sum(axis=1))])
        at = per_step[np.arange(0, steps[i], CHECKPOINT)].astype("<u4")
        states = np.stack(marks[i][::-1]).astype("<u8") if marks[i] else np.zeros((0, LANES), "<u8")
        stream = w[k].astype("<u4")
        body = _HEAD.pack(b"RANS", LANES, int(n[i]), len(at), len(stream)) + at.tobytes() + states.tobytes() + stream.tobytes()
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


def decode_frames(payloads: list[bytes], freq: np.ndarray) -> list[np.ndarray]:
    """The symbols of each payload."""
    blocks, owner = [], []
    for i, p in enumerate(payloads):
        view, at = memoryview(p), 0
        while at < len(p):
            if len(p) - at < _HEAD.size + 4:
                raise ValueError("not a token frame")
            _, lanes, _, n_marks, n_words = _HEAD.unpack_from(p, at)
            size = _HEAD.size + 4 * n_marks + 8 * n_marks * lanes + 4 * n_words + 4
            blocks.append(view[at : at + size])
            owner.append(i)
            at += size
    out: list[list[np.ndarray]] = [[] for _ in payloads]
    for lo in range(0, len(blocks), SIDE_BY_SIDE):
        for i, ids in zip(owner[lo:], _decode_blocks(blocks[lo : lo + SIDE_BY_SIDE], freq)):
            out[i].append(ids)
    return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.int32), *x]) for x in out]


def _decode_blocks(payloads: list[memoryview], freq: np.ndarray) -> list[np.ndarray]:
    """The symbols of each block; the pieces between checkpoints of all blocks are decoded side by side."""
    cum = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint64)
    f64 = freq.astype(np.uint64)
    symbol_of = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    streams, starts, states, left, owner, base = [], [], [], [], [], 0
    for i, p in enumerate(payloads):
        if zlib.crc32(p[:-4]) != struct.unpack("<I", p[-4:])[0]:
            raise ValueError("a token frame has a wrong checksum")
        magic, lanes, n, n_marks, n_words = _HEAD.unpack_from(p)
        if magic != b"RANS" or lanes != LANES:
            raise ValueError("not a token frame")
        at = np.frombuffer(p, "<u4", n_marks, _HEAD.size)
        states.append(np.frombuffer(p, "<u8", n_marks * LANES, _HEAD.size + 4 * n_marks).reshape(n_marks, LANES))
        streams.append(np.frombuffer(p, "<u4", n_words, _HEAD.size + 4 * n_marks + 8 * n_marks * LANES))
        starts.append(at.astype(np.int64) + base)
        left.append(n - np.arange(n_marks) * CHECKPOINT * LANES)
        owner.append(np.full(n_marks, i))
        base += n_words
    stream = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
    pointer, left, owner = np.concatenate(starts), np.minimum(np.concatenate(left), CHECKPOINT * LANES), np.concatenate(owner)
    state = np.concatenate(states).astype(np.uint64)
    out = np.zeros((len(pointer), CHECKPOINT, LANES), dtype=np.int32)
    lane = np.arange(LANES)
    for s in range(int(-(-left.max(initial=0) // LANES))):
        live = s * LANES + lane[None, :] < left[:, None]
        slot = (state & _U((1 << PRECISION) - 1)).astype(np.int64)
        sym = symbol_of[slot]
        out[:, s] = sym
        state = np.where(live, f64[sym] * (state >> _U(PRECISION)) + slot.astype(np.uint64) - cum[sym], state)
        need = live & (state < _LOW)
        turn = np.cumsum(need, axis=1)
        word = stream[np.minimum(pointer[:, None] + turn - 1, len(stream) - 1)]
        state = np.where(need, state << _U(32) | word, state)
        pointer = pointer + turn[:, -1]
    flat = out.reshape(len(pointer), CHECKPOINT * LANES)
    first = np.searchsorted(owner, np.arange(len(payloads) + 1))
    return [np.concatenate([flat[k, : left[k]] for k in range(first[i], first[i + 1])]) if first[i + 1] > first[i] else np.zeros(0, np.int32) for i in range(len(payloads))]


def _encoder(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = shared_word_ids(path)
        end = np.array([END_ID], "<u2").tobytes()

        def coded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pieces = Pieces(raw, offsets, "lower", SPECIALS)
            hashes, index, inverse = np.unique(pieces.hash, return_index=True, return_inverse=True)
            ids, lengths = cache.expand(cache.slots(hashes, lambda k: pieces.word(index[k]))[inverse])
            return ids.astype("<u2"), sums_by(pieces.count, lengths)

        for batch, raw, offsets in chunks(batches, limit=1 << 20):
            if batch.num_rows == 1 and len(raw) > PART_BYTES:
                small = np.concatenate([coded(x, np.array([0, len(x)]))[0] for x in parts_of(raw)])
                n = np.array([len(small)])
            else:
                small, n = coded(raw, offsets)
            cut = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n + 1, pa.int64()), pa.array([small[cut[i] : cut[i + 1]].tobytes() + end for i in range(len(n))], pa.binary())], ["doc_id", "n", "ids"]
            )

    return rows


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["symbol", "n"])


def _framer(table):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, shard = table.value, TaskContext.get().partitionId()
        ids, docs, lengths = [[]], [[]], [[]]
        size, held, frame, first = 0, 0, 0, 0  # held: tokens of the frame that is being filled

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs, lengths, size, frame, first
            arrays = [np.concatenate(x) if x else np.zeros(0, np.uint16) for x in ids]
            totals = np.array([len(a) for a in arrays])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(arrays), shard), pa.int32()), pa.array(np.arange(frame, frame + len(arrays)), pa.int64()),
                    pa.array(first + np.concatenate([[0], np.cumsum(totals)[:-1]]), pa.int64()), pa.array(totals, pa.int64()),
                    pa.array(docs, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64())), pa.array(encode_frames(arrays, freq), pa.binary()),
                ],
                ["shard", "frame", "first_token", "n_tokens", "doc_ids", "lengths", "payload"],
            )
            frame, first = frame + len(arrays), first + int(totals.sum())
            ids, docs, lengths, size = [[]], [[]], [[]], 0
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(text.as_buffer(), "<u2").copy()
                ids[-1].append(x)
                docs[-1].append(doc)
                lengths[-1].append(len(x))
                size, held = size + len(x), held + len(x)
                if held >= FRAME_TOKENS:
                    held = 0
                    if size >= SIDE_BY_SIDE * FRAME_TOKENS:
                        yield flush()
                    else:
                        ids.append([])
                        docs.append([])
                        lengths.append([])
        while ids and not ids[-1]:
            ids.pop(), docs.pop(), lengths.pop()
        if ids:
            yield flush()

    return rows


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encodes the whole text of every document and writes the token dataset to `path`."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    largest = max(load_tokenizer(tokenizer).get_vocab(with_added_tokens=True).values(), default=0)
    if max(largest, END_ID) >= 1 << 16:
        raise ValueError(f"token files hold ids of 16 bits; this vocabulary has {largest}")
    coded = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(tokenizer), "doc_id long, n long, ids binary"), "ids")
    counted = coded.select("ids").mapInArrow(_count_rows, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()  # a row for each symbol of the vocabulary at most
    counts = np.zeros(1 << 16, dtype=np.int64)
    counts[counted.column("symbol").to_numpy()] = counted.column("n").to_numpy()
    freq = scaled(counts)
    used = np.flatnonzero(freq)
    spark.createDataFrame(pa.table({"symbol": pa.array(used, pa.int32()), "frequency": pa.array(freq[used], pa.int64())})).coalesce(1).write.parquet(f"{path}/table")
    table = spark.sparkContext.broadcast(freq)
    schema = "shard int, frame long, first_token long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"
    # equal doc_ids, the null one among them, are dealt by length, ids and place, so that many of them fill many ranges
    placed = coded.withColumn("at", F.monotonically_increasing_id())
    framed = placed.repartitionByRange("doc_id", "n", F.substring("ids", 1, 64), "at").sortWithinPartitions("doc_id", "n", "ids").select("doc_id", "ids").mapInArrow(_framer(table), schema)
    framed.write.option("compression", "uncompressed").parquet(f"{path}/frames")
    drop_staged(coded)


def _reader(table):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = table.value
        for batch in batches:
            sizes = np.cumsum(batch.column(4).to_numpy())
            lo = hi = 0
            while hi < batch.num_rows:  # SIDE_BY_SIDE frames, fewer where they are long, one at least
                lo, least = hi, sizes[hi - 1] if hi else 0
                hi = min(lo + SIDE_BY_SIDE, max(lo + 1, int(np.searchsorted(sizes, least + 2 * SIDE_BY_SIDE * FRAME_TOKENS, side="right"))))
                part = batch.slice(lo, hi - lo)
                decoded = decode_frames(part.column(3).to_pylist(), freq)
                for i, ids in enumerate(decoded):
                    lengths = np.array(part.column(2)[i].as_py(), dtype=np.int64)
                    cut = np.concatenate([[0], np.cumsum(lengths)])
                    if cut[-1] != len(ids):
                        raise ValueError("a token frame has another length than its documents")
                    raw = ids.astype("<u4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part.column(1)[i].as_py(), pa.int64()), pa.array(cut[:-1] + part.column(0)[i].as_py(), pa.int64()),
                            pa.array([raw[cut[k] : cut[k + 1]].tobytes() for k in range(len(lengths))], pa.binary()),
                        ],
                        ["doc_id", "start", "ids"],
                    )

    return rows


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (32-bit little endian) of every document of a token dataset."""
    entries = spark.read.parquet(f"{path}/table").toArrow()  # a row for each symbol of the vocabulary at most
    freq = np.zeros(1 << 16, dtype=np.int64)
    freq[entries.column("symbol").to_numpy()] = entries.column("frequency").to_numpy()
    frames = spark.read.parquet(f"{path}/frames")
    sums = frames.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row for each partition that was written: their number bounds the window and the broadcast
    before = sums.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = frames.join(F.broadcast(before), "shard").select((F.col("before") + F.col("first_token")).alias("first"), "doc_ids", "lengths", "payload", "n_tokens")
    return placed.mapInArrow(_reader(spark.sparkContext.broadcast(freq)), "doc_id long, start long, ids binary")


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes all documents as a token dataset, reads it back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path).select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
