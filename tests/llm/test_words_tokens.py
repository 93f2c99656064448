import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sparkquill.llm import _arrays as A
from sparkquill.llm import rans_tokens, word_bpe
from sparkquill.llm._tokens import Pieces, WordIds, load_tokenizer, parts_of, sums_by, tokenizer_path

pytest.importorskip("public_tokenizers")

TEXTS = ["", None, " ", "Hello world, it's Dr. Who's 2nd  try!\n\n x", "don't I'LL we've 'tis", "é ñ ß Σσς İ ½ ² 中文 😀‍", "a\x00b\x1c c", "<|endoftext|> and <|startoftext|>x", "\n \t ", "the " * 3000, "repeated row", "repeated row", "'s", " 's", "x" * 5000]


def test_words_equal_a_regular_expression():
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\t\x0b\x85 abcXYZ09.-é中😀\x00") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["", None]
    for table, pattern in ((A.SPACE_SPLIT, "[^\x20\x09-\x0d]+"), (A.ALNUM_SPLIT, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        raw, off = A.text_buffers(pa.array(texts, pa.string()))
        w = A.Words(raw, off, table)
        seen = {}
        for i, t in enumerate(texts):
            want = re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            at = range(w.bounds[i], w.bounds[i + 1])
            got = [re.sub("[A-Z]", lambda m: m[0].lower(), raw[w.start[k] : w.end[k]].tobytes().decode()) for k in at]
            assert got == want
            for k, word in zip(at, want):
                assert seen.setdefault(int(w.hash[k]), word) == word
        assert len(seen) == len(set(seen.values()))


def test_windows_of_short_and_long_texts():
    raw, off = A.text_buffers(pa.array(["a b c d e f", "a b", "", "b a", "a b c d e"]))
    h, first, doc = A.windows(A.Words(raw, off, A.SPACE_SPLIT), 5)
    assert doc.tolist() == [0, 0, 1, 3, 4] and h[0] == h[4] and len(set(h.tolist())) == 4


@pytest.mark.parametrize("name,style,specials", [("byte_bpe_50k.json", "bytes", word_bpe.SPECIALS), ("word_bpe_49k.json", "lower", rans_tokens.SPECIALS)])
def test_split_words_encode_as_the_library_does(name, style, specials):
    rng = random.Random(2)
    alphabet = list("  \n\t'' ''srevelltmd STRELl.,!?0123 ab é Σσς İ ß ½中  \x00\x1c\r_$Ⅷ") + ["<|endoftext|>", "<|startoftext|>", "n't", " 'll"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    tokenizer, cache = load_tokenizer(tokenizer_path(name)), WordIds(tokenizer_path(name), limit=400)
    for lo in range(0, len(texts), 37):
        part = texts[lo : lo + 37]
        pieces = Pieces(*A.text_buffers(pa.array(part, pa.string())), style, specials)
        distinct, index, inverse = np.unique(pieces.hash, return_index=True, return_inverse=True)
        ids, lengths = cache.expand(cache.slots(distinct, lambda k: pieces.word(index[k]))[inverse])
        cut = np.concatenate([[0], np.cumsum(sums_by(pieces.count, lengths))])
        for i, t in enumerate(part):
            assert ids[cut[i] : cut[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_rans_round_trip_and_checksum():
    rng = np.random.default_rng(3)
    frames = [rng.zipf(1.3, n) % 5000 for n in (0, 1, 31, 32, 33, 20_000, 70_001)]
    freq = rans_tokens.scaled(np.bincount(np.concatenate(frames), minlength=5001))
    assert freq.sum() == 1 << rans_tokens.PRECISION and freq[5000] == 0
    payloads = rans_tokens.encode_frames(frames, freq)
    for got, want in zip(rans_tokens.decode_frames(payloads, freq), frames):
        assert got.tolist() == want.tolist()
    broken = bytearray(payloads[5])
    broken[200] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans_tokens.decode_frames([bytes(broken)], freq)
    for counts in ([0], [5], [1] * 40_000 + [10**9]):
        f = rans_tokens.scaled(np.array(counts))
        assert f.sum() in (0, 1 << rans_tokens.PRECISION) and ((f > 0) == (np.array(counts) > 0)).all()


def table(spark, texts, parts=3):
    rows = [(i * 7 % 1000, t, "x", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n double").repartition(parts), rows


def test_token_files(spark):
    docs, rows = table(spark, TEXTS)
    got = {r.doc_id: r for r in rans_tokens.token_digests(docs).collect()}
    start, tokenizer = 0, load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert rans_tokens.token_digests(docs.limit(0)).count() == 0


def test_word_bpe(spark, tmp_path):
    docs, rows = table(spark, TEXTS)
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in word_bpe.digest(word_bpe.encode_and_decode(docs)).collect()}
    tokenizer = load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert word_bpe.encode_and_decode(docs.limit(0)).count() == 0


def test_word_of_more_ids_than_16_bits_count(spark, tmp_path):
    rng = random.Random(4)
    long = "".join(rng.choice("0123456789") for _ in range(300_000))
    texts = ["plain words before", long, "plain words after 12 it", long[:500] + " tail", *TEXTS]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in word_bpe.encode_and_decode(spark.read.parquet(str(tmp_path / "d"))).collect()}
    tokenizer = load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(want[1]) > 65_535
    for i, ids in enumerate(want):
        assert got[i].ids == ids and got[i].decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_many_empty_texts_make_frames_in_linear_time(spark):
    import time

    docs = spark.range(200_000).selectExpr("id AS doc_id", "'' AS text").coalesce(1)
    began = time.time()
    assert rans_tokens.token_digests(docs).filter("n_tokens = 1 AND start = doc_id").count() == 200_000
    assert time.time() - began < 60


def test_large_vocabularies_are_refused(spark, tmp_path):
    import json

    words = {f"t{k}": k for k in range(70_000)}
    (tmp_path / "t.json").write_text(json.dumps({"version": "1.0", "added_tokens": [], "model": {"type": "WordLevel", "vocab": words, "unk_token": "t0"}}))
    with pytest.raises(ValueError, match="16 bits"):
        rans_tokens.token_digests(spark.createDataFrame([(1, "t1")], "doc_id long, text string"), str(tmp_path / "t.json"))


def test_parts_of_a_long_text_have_its_words():
    rng = random.Random(8)
    alphabet = list("   \n\n\t'' streVLld.,é Σς \u0301中 9  \u00a0") + ["ab", "cd ", "don't ", " 1\u0301"]
    for _ in range(300):
        raw = np.frombuffer("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))).encode(), np.uint8)
        cut = parts_of(raw, rng.randint(1, 40))
        assert b"".join(x.tobytes() for x in cut) == raw.tobytes()
        for style, specials in (("bytes", word_bpe.SPECIALS), ("lower", rans_tokens.SPECIALS)):
            whole = Pieces(raw, np.array([0, len(raw)]), style, specials)
            parts = [Pieces(x, np.array([0, len(x)]), style, specials) for x in cut]
            assert [p.word(i) for p in parts for i in range(len(p.start))] == [whole.word(i) for i in range(len(whole.start))]
            assert [h for p in parts for h in p.hash.tolist()] == whole.hash.tolist()


def test_frames_of_a_long_document_have_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(12)
    frames = [(rng.zipf(1.3, n) % 5000).astype(np.uint16) for n in (50_000, 3_000_000, 131_073, 131_072)]
    freq = rans_tokens.scaled(np.bincount(np.concatenate(frames), minlength=5000))
    tracemalloc.start()
    payloads = rans_tokens.encode_frames(frames, freq)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    for got, want in zip(rans_tokens.decode_frames(payloads, freq), frames):
        assert (got == want).all()
    broken = bytearray(payloads[1])
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum|not a token frame"):
        rans_tokens.decode_frames([bytes(broken)], freq)


def test_long_texts_and_many_null_ids(spark, tmp_path):
    """A text of several parts and blocks beside short ones, and half of the rows without a doc_id: both tokenizers equal the library."""
    long = " ".join(f"Word{k % 977}, it's" for k in range(700_000))
    rows = [(3, "short one"), (5, long), (6, "after it"), *[(None, f"null {k % 3}") for k in range(40)]]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    files, pieces = load_tokenizer(tokenizer_path("word_bpe_49k.json")), load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = files.encode(t, add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, rans_tokens.token_digests(docs).collect()), key=lambda r: r[1])
    assert got[40:] == want[40:]
    assert sorted((g[2], g[3]) for g in got[:40]) == sorted((w[2], w[3]) for w in want[:40])
    for r in word_bpe.digest(word_bpe.encode_and_decode(docs.filter("doc_id IS NOT NULL"))).collect():
        ids = pieces.encode(dict(rows[:3])[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_rows_that_move_between_the_scans_raise_or_stay_right(spark):
    """Each evaluation deals the rows to other partitions: blocks then hold other words the second time."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def anywhere(x):
        return pd.Series(np.random.default_rng().integers(0, 1 << 40, len(x)))

    words = [f"only{k:03d}" for k in range(64)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").withColumn("r", anywhere.asNondeterministic()("doc_id")).repartition(8, "r")
    try:
        got = {r.doc_id: r.decoded for r in word_bpe.encode_and_decode(docs).collect()}
    except Exception as e:
        assert "other words the second time" in str(e)
    else:
        assert got == dict(enumerate(words))
    # the same rows in the same blocks, in another order: right
    shuffled = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").coalesce(1).mapInPandas(lambda it: (b.sample(frac=1.0) for b in it), "doc_id long, text string")
    assert {r.doc_id: r.decoded for r in word_bpe.encode_and_decode(shuffled).collect()} == dict(enumerate(words))
