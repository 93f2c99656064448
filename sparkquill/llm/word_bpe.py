"""Operator 4: BPE encoding and decoding through a table of distinct words.

Texts are split into the words that merges never cross, and the words of a block of about BLOCK_BYTES of text become numbers in a
list of the block's distinct words. The lists are cut into shards by the words' hashes; the task of a shard sees every
distinct word once and encodes it once, whichever blocks hold it. The ids go back to their blocks and are joined to the words'
positions; decoding joins the ids to the vocabulary's pieces (a broadcast join in numpy: the vocabulary bounds the table) and
puts their bytes together again.

What is shuffled: each block's distinct words, their ids, and its numbered words (compressed); a frequent word costs one
entry for each block, so no key is hot. The numbers of shards and of block partitions follow from the bytes of the texts. The
blocks are made twice, once for their words and once for their numbers, from the same partitions of `docs`; file splits
are pinned for the session. Both times a block sums up its distinct words in 128 bits (a digest of the sorted hashes of each shard): a block that holds
other words the second time raises an error, as the rows then moved between the scans (write such an input down first). Rows
in another order within a block do no harm: numbers and doc_ids come from one scan, and words are listed by hash.

A word may have any length: its ids are counted in 32 bits. Null texts are empty and have no ids. Rows that repeat are encoded each. The special token counts as one word. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm._arrays import chunks
from sparkquill.llm._stage import pin_splits
from sparkquill.llm._tokens import Pieces, WordIds, expand, load_tokenizer, parts_of, sums_by, tokenizer_path

BLOCK_BYTES = 6 << 20
ROW_WORDS = 250_000
#: Text for each shard of words and for each partition of blocks, and the most shards: a shard streams its words, so its memory doesn't grow with them.
SHARD_BYTES, PART_BYTES, MOST_SHARDS = 16 << 20, 2 * BLOCK_BYTES, 4096
SPECIALS = ("<|endoftext|>",)
_U = np.uint64


def _pack(a: np.ndarray) -> bytes:
    return struct.pack("<Q", a.nbytes) + pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], struct.unpack_from("<Q", b)[0], codec="zstd", asbytes=True), kind)


def _mark(hashes: np.ndarray) -> int:
    """128 bits of a sorted list of word hashes."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), "little")


def _marks(marks: list[int]) -> bytes:
    return (sum(marks) % (1 << 128)).to_bytes(16, "little")


class _Block:
    """The words of some documents: distinct words sorted by shard and hash, and the number of each word in that order."""

    def __init__(self, parts: list[tuple], shards: int):
        hashes = np.concatenate([p.hash for _, p in parts]) if parts else np.zeros(0, np.uint64)
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        shard = (distinct % _U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        self.numbers = back[inverse].astype(np.uint32)
        self.hash, self.shard, self.index = distinct[order], shard[order], index[order]
        self.edge = np.searchsorted(self.shard, np.arange(shards + 1))
        self.marks = [_mark(self.hash[a:b]) for a, b in zip(self.edge[:-1], self.edge[1:]) if b > a]
        self.begin = np.cumsum([0] + [len(p.hash) for _, p in parts])
        self.parts = parts

    def word(self, k: int) -> str:
        i = self.index[k]
        part = int(np.searchsorted(self.begin, i, side="right")) - 1
        return self.parts[part][1].word(i - self.begin[part])


def _blocks(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[tuple[int, _Block]]:
    base, number, parts, size = 0, 0, [], 0
    for batch, raw, offsets in chunks(batches, limit=1 << 20):
        base = batch.column(2)[0].as_py() << 24  # the partition of the scan
        # a long text, alone in its chunk, is split part by part; its row stands with the first
        pieces = parts_of(raw) if batch.num_rows == 1 else [raw]
        parts += [(batch if not i else None, Pieces(x, offsets if len(pieces) == 1 else np.array([0, len(x)]), "bytes", SPECIALS)) for i, x in enumerate(pieces)]
        size += len(raw)
        if size >= BLOCK_BYTES:
            yield base + number, _Block(parts, shards)
            number, parts, size = number + 1, [], 0
    if parts:
        yield base + number, _Block(parts, shards)


def _word_rows(shards: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in _blocks(batches, shards):
            marks = iter(b.marks)
            for s, (lo, hi) in enumerate(zip(b.edge[:-1].tolist(), b.edge[1:].tolist())):
                if hi > lo:
                    words = [b.word(k).encode("utf-8", "surrogatepass") for k in range(lo, hi)]
                    lengths = np.array([len(w) for w in words], dtype="<u4")
                    text = np.frombuffer(b"".join(words), np.uint8)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([s], pa.int32()), pa.array([_pack(lengths)], pa.binary()), pa.array([_pack(text)], pa.binary()), pa.array([_marks([next(marks)])], pa.binary())],
                        ["block", "shard", "lengths", "words", "mark"],
                    )

    return rows


def _encode_rows(path: str):
    """The ids of each list of words: a holds the ids, b the ids of each word, n the bytes of an id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordIds(path)
        for batch in batches:
            for block, shard, lengths, words, mark in zip(*(batch.column(k).to_pylist() for k in range(5))):
                text = _unpack(words, "u1").tobytes()
                end = np.cumsum(_unpack(lengths, "<u4").astype(np.int64))
                start = np.concatenate([[0], end[:-1]])
                parts = [text[a:b] for a, b in zip(start.tolist(), end.tolist())]
                ids, size = cache.encode_words(parts)
                width = 2 if ids.max(initial=0) < 65536 else 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([0], pa.int32()), pa.array([shard], pa.int32()), pa.array([_pack(ids.astype(f"<u{width}"))], pa.binary()), pa.array([_pack(size.astype("<u4"))], pa.binary()), pa.array([width], pa.int64()), pa.array([mark], pa.binary())],
                    ["block", "kind", "seq", "a", "b", "n", "mark"],
                )

    return rows


def _number_rows(shards: int):
    """doc_id, text -> rows of numbered words: a holds the numbers, b the words of each document, docs its doc_ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in _blocks(batches, shards):
            ids = pa.concat_arrays([batch.column(0) for batch, _ in b.parts if batch is not None])
            first = np.concatenate([np.full(len(p.count), batch is not None) for batch, p in b.parts])
            count = np.bincount(np.cumsum(first) - 1, np.concatenate([p.count for _, p in b.parts])).astype(np.int64)  # exact up to 2**53
            end = np.cumsum(count)
            lo, seq = 0, 0
            while lo < len(count):
                first = end[lo] - count[lo]
                hi = max(lo + 1, int(np.searchsorted(end, first + ROW_WORDS, side="right")))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()), pa.array([1], pa.int32()), pa.array([seq], pa.int32()),
                        pa.array([_pack(_planes(b.numbers[first : end[hi - 1]]))], pa.binary()), pa.array([_pack(count[lo:hi].astype("<u4"))], pa.binary()),
                        pa.array([ids.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())), pa.array([len(b.hash)], pa.int64()), pa.array([_marks(b.marks)], pa.binary()),
                    ],
                    ["block", "kind", "seq", "a", "b", "docs", "n", "mark"],
                )
                lo, seq = hi, seq + 1

    return rows


def _planes(numbers: np.ndarray) -> np.ndarray:
    """Numbers by byte: the high bytes, which repeat, lie together."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)


class _Pieces:
    """The table of the vocabulary's pieces as bytes."""

    def __init__(self, pieces: list[bytes]):
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return expand(self.flat, self.offset, ids)


def piece_table(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, '' where an id is unused. Printable bytes stand for themselves, the others for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocabulary = load_tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, k in vocabulary.items():
        out[k] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return out


def _join_rows(pieces):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Pieces(pieces.value)
        block, ids, size, marks, offset, flat = None, [], [], [], None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at, kind, a, b = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4))
                if at != block:
                    block, ids, size, marks, offset = at, [], [], [], None
                if kind == 0:
                    marks.append(int.from_bytes(batch.column(7)[i].as_py(), "little"))
                    ids.append(_unpack(a, f"<u{batch.column(6)[i].as_py()}").astype(np.int32))
                    size.append(_unpack(b, "<u4").astype(np.int64))
                    continue
                if offset is None:
                    offset = np.concatenate([[0], np.cumsum(np.concatenate(size))]) if size else np.zeros(1, np.int64)
                    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                    if len(offset) - 1 != batch.column(6)[i].as_py() or _marks(marks) != batch.column(7)[i].as_py():
                        raise RuntimeError("a block holds other words the second time: write the input down before encoding it")
                planes = _unpack(a, "u1").reshape(4, -1)
                numbers = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
                words = _unpack(b, "<u4").astype(np.int64)
                docs = batch.column(5)[i].as_py()
                cut = np.concatenate([[0], np.cumsum(words)])
                lo = 0
                while lo < len(docs):  # some 100,000 words at a time
                    hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + 100_000, side="right")) - 1)
                    part, lengths = expand(flat, offset, numbers[cut[lo] : cut[hi]])
                    n = sums_by(words[lo:hi], lengths)
                    text, text_lengths = table.bytes_of(part)
                    ends = np.concatenate([[0], np.cumsum(sums_by(n, text_lengths))])
                    list_offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    raw = text.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[lo:hi], pa.int64()), pa.ListArray.from_arrays(pa.array(list_offsets), pa.array(part, pa.int32())),
                            pa.array([raw[ends[k] : ends[k + 1]].decode("utf-8", "replace") for k in range(hi - lo)], pa.string()),
                        ],
                        ["doc_id", "ids", "decoded"],
                    )
                    lo = hi

    return rows


def encode_and_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>), decoded (string) of the whole text of every document."""
    spark: SparkSession = docs.sparkSession
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    pin_splits(spark)
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, parts = min(MOST_SHARDS, 8 + size // SHARD_BYTES), 8 + size // PART_BYTES
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().cast("long").alias("partition"))
    words = texts.mapInArrow(_word_rows(shards), "block long, shard int, lengths binary, words binary, mark binary")
    coded = words.repartitionById(shards, F.col("shard")).mapInArrow(_encode_rows(path), "block long, kind int, seq int, a binary, b binary, n long, mark binary")
    numbers = texts.mapInArrow(_number_rows(shards), "block long, kind int, seq int, a binary, b binary, docs array<long>, n long, mark binary")
    both = coded.select("block", "kind", "seq", "a", "b", F.lit(None).cast("array<long>").alias("docs"), "n", "mark").unionByName(numbers)
    pieces = spark.sparkContext.broadcast(piece_table(path))  # the vocabulary bounds its size
    # neighbouring partitions of the scan, and the blocks of one, go to different tasks in turn
    place = F.pmod(F.shiftright("block", 24) + 7 * F.col("block").bitwiseAND(F.lit((1 << 24) - 1)), F.lit(parts)).cast("int")
    return both.repartitionById(parts, place).sortWithinPartitions("block", "kind", "seq").mapInArrow(_join_rows(pieces), "doc_id long, ids array<int>, decoded string")


def digest(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
