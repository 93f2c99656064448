"""Anchors and quotes against brute force."""

import random

import numpy as np
import pytest

from sparkquill.operators import anchors, evidence

PAGES = "doc_id string, page int, text string"


def brute_anchors(text, size):
    return {int(anchors.window_minima(np.frombuffer(text[i : i + size].encode(), np.uint8).astype(np.uint64), size)[0]) for i in range(len(text) - size + 1)}


@pytest.mark.parametrize("step", [7, 1 << 20])
def test_anchors_are_those_of_every_window(spark, monkeypatch, step):
    monkeypatch.setattr(anchors, "STEP", step)
    draw = random.Random(3)
    texts = ["".join(draw.choices("ab1", k=n)) for n in (0, 1, 9, 10, 39, 40, 41, 300)] + ["a" * 200]
    for size in anchors.LEVELS:
        rows, found = anchors._batch_anchors([t.encode() for t in texts], size)
        got = {(int(r), int(a)) for r, a in zip(rows, found, strict=True)}
        assert got == {(i, a) for i, t in enumerate(texts) for a in brute_anchors(t, size)}


def test_anchored_rows(spark):
    df = spark.createDataFrame([(1, "x" * 50, 40), (2, None, 40), (3, "abcde", 5), (4, "", None)], "id int, t string, level int")
    assert {r.id for r in anchors.anchored(df, "t", [40, 5], "level").collect()} == {1, 3}
    both = anchors.anchored(df.drop("level"), "t", [40, 5])
    assert both.columns == ["id", "anchor"] and both.filter("id = 1").count() == 2
    assert anchors.anchored(df, "t", []).count() == 0


def test_long_texts_have_few_anchors():
    text = "".join(random.Random(1).choices("abcdefghij0123456789", k=50_000)).encode()
    assert len(anchors._batch_anchors([text], 40)[0]) < len(text) / 10


def corpus(draw, n):
    """Texts over few letters, so that pieces recur, with copies of one long passage."""
    passage = "".join(draw.choices("abc", k=90))
    return [(f"d{draw.choice('0012')}", f"c{i}", "".join(draw.choices("ab", k=draw.randint(0, 60))) + (passage if i % 3 == 0 else "") + "".join(draw.choices("ab", k=30))) for i in range(n)]


@pytest.fixture(scope="module")
def asked():
    draw = random.Random(5)
    rows = corpus(draw, 40)
    quotes = []
    for i in range(60):
        paper, _, text = draw.choice(rows)
        a, n = draw.randint(0, 30), draw.choice([1, 2, 4, 5, 9, 10, 19, 20, 39, 40, 60])
        q = text[a : a + n]
        quotes.append((f"q{i}", 1, paper, q if i % 4 else q + "zz" if i % 8 else "zz" + q))
    return rows, [*quotes, ("empty", 1, "d0", " .,"), ("null", 1, "d0", None), ("nowhere", 1, "d9", "abab")]


def test_resolve_equals_brute_force(spark, asked):
    rows, quotes = asked
    chunks = spark.createDataFrame(rows, "paper_id string, chunk_id string, text string")
    found = evidence.resolve(spark.createDataFrame(quotes, "qid string, ev int, paper_id string, quote string"), chunks).collect()
    want = set()
    for qid, ev, paper, quote in quotes:
        if quote is None:
            continue
        q = quote.strip(" .,")
        own = [(c, t) for p, c, t in rows if p == paper]
        whole = {c for c, t in own if q in t}
        want |= {(qid, ev, c, True) for c in whole} or {(qid, ev, c, False) for c, t in own if q[:40] in t or q[-40:] in t}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert any(not w[3] for w in want)


def test_anywhere_equals_brute_force(spark, asked):
    rows, quotes = asked
    chunks = spark.createDataFrame([(c, t) for _, c, t in rows] + [("none", None)], "chunk_id string, text string")
    found = evidence.resolve_anywhere(spark.createDataFrame([(a, b, q) for a, b, _, q in quotes], "qid string, ev int, quote string"), chunks).collect()
    want = {(a, b, c) for a, b, _, q in quotes if q is not None for _, c, t in rows if q.strip(" .,") in t}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_pages_equal_brute_force(spark, asked):
    rows, quotes = asked
    pages, of = {}, {}
    for p, _, t in rows:
        pages.setdefault(p, []).append(t)
    for p, texts in pages.items():
        of |= {(p, i + 1): t for i, t in enumerate(texts)}
    draw = random.Random(9)
    crossing = []
    for i in range(30):
        p = draw.choice(sorted(pages))
        n = draw.randrange(len(pages[p]) - 1)
        crossing.append((f"x{i}", 1, p, pages[p][n][-draw.choice([41, 45, 20]) :] + pages[p][n + 1][: draw.randint(1, 50)]))
    quotes = [q for q in quotes if q[3] is not None] + crossing
    found = evidence.quote_pages(
        spark.createDataFrame(quotes, "qid string, ev int, paper_id string, quote string"), spark.createDataFrame([(p, n, t) for (p, n), t in of.items()], PAGES)
    ).collect()
    want = {}
    for qid, _, p, quote in quotes:
        if p not in pages:
            continue
        q, texts = quote.strip(" .,"), pages[p]
        whole = [i + 1 for i, t in enumerate(texts) if q in t]
        starts = [i + 1 for i in range(len(texts) - 1) if q in texts[i] + texts[i + 1] and q[:40] in texts[i]]
        want[qid] = whole or starts[:1]
    assert {r.qid: r.found_pages for r in found} == want and len(found) == len(want)
    assert any(len(want[x[0]]) == 1 for x in crossing)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "qid string, ev int, paper_id string, quote string")
    chunks = spark.createDataFrame([("p", "c", "some text")], "paper_id string, chunk_id string, text string")
    one = spark.createDataFrame([("q", 1, "p", "some")], none.schema)
    assert evidence.resolve(none, chunks).count() == evidence.resolve_anywhere(none, chunks).count() == 0
    assert evidence.resolve(one, chunks.limit(0)).count() == evidence.resolve_anywhere(one, chunks.limit(0)).count() == 0
    assert evidence.quote_pages(none, spark.createDataFrame([], PAGES)).count() == 0


def test_anchors_of_a_full_batch_are_taken_in_parts():
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    class Held:
        columns, schema = ["id", "t"], StructType([StructField("id", LongType()), StructField("t", StringType())])

        def mapInArrow(self, run, schema):
            return run

    run = anchors.anchored(Held(), "t", [40])
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([f"{i} " + "sand and kelp " * 100 for i in range(10_000)])], ["id", "t"])
    tracemalloc.start()
    rows = [r for b in run([batch]) for r in b.column("id").unique().to_pylist()]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert sorted(set(rows)) == list(range(10_000)) and peak < 100


def test_only_papers_that_are_asked_for_are_cut(spark, tmp_path):
    from sparkquill.plans import catalog

    docs = [(n, f"about the wax of comb number {n} and its many cells", "notes", "en") for n in range(1, 41)] + [(40, "a second text of forty", "notes", "en"), (None, "x", "notes", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    asked = catalog.quotes(spark, str(tmp_path))
    assert sorted(r.paper_id for r in catalog.asked_chunks(spark, str(tmp_path), asked).collect()) == ["20", "40", "40"]
    assert catalog.evidence_unresolved(spark, str(tmp_path)).collect() == []
    assert sorted((r.qid, r.chunk_id, r.whole) for r in catalog.evidence_resolve(spark, str(tmp_path)).select("qid", "chunk_id", "whole").collect())[0] == (20, "0000000020:000", True)


def test_texts_have_anchors_at_the_levels_that_their_paper_asks_for(spark, monkeypatch):
    """One paper with a short quote doesn't make the other papers' texts rows of an anchor for each character."""
    import hashlib

    from sparkquill.operators import evidence

    made, plain = [], evidence.anchored
    monkeypatch.setattr(evidence, "anchored", lambda *a: made.append(plain(*a)) or made[-1])
    long = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(60))
    chunks = spark.createDataFrame([("a", "a:0", "a kiln and its glaze"), ("b", "b:0", long)], "paper_id string, chunk_id string, text string")
    asked = spark.createDataFrame([("q", 1, "a", "glaze"), ("q", 2, "b", long[300:400])], "qid string, ev int, paper_id string, quote string")
    assert {(r.ev, r.chunk_id) for r in evidence.resolve(asked, chunks).collect()} == {(1, "a:0"), (2, "b:0")}
    assert made[1].filter("paper_id = 'b'").count() < len(long) / 4 and made[1].filter("paper_id = 'a'").count() > 5
