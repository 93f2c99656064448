import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkquill.functions.stem import ENGLISH_STOP, stem
from sparkquill.operators import block_index, chunking, evidence, fusion, lexical, metrics, ranks, vectors

CHUNKS = [
    ("bees:00", "bees", "Hives", 4, "the queen lays her eggs in wax cells of the brood comb"),
    ("bees:01", "bees", "Harvest", 9, "smoke calms a colony before honey frames are lifted"),
    ("kiln:00", "kiln", "Firing", 2, "stoneware glaze melts once the kiln passes twelve hundred degrees"),
    ("tide:00", "tide", "Moon", 1, "spring tides follow the new moon and the full moon"),
    ("tide:01", "tide", "Harbours", 6, "neap tides leave shallow harbours dry for hours"),
    ("tide:02", "tide", "Tables", 7, "printed tables give the height of the water for every port"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, paper_id string, section string, page int, text string").cache()


def ask(spark, *questions):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "qid string, question string")


def ids(df, qid="q0"):
    return [r.chunk_id for r in df.filter(F.col("qid") == qid).orderBy("rank").collect()]


def brute_bm25(question, texts):
    toks = {k: [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split() if w not in lexical.T.STOPWORDS] for k, t in texts.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    asked = [w for w in question.lower().replace("?", "").split() if w not in lexical.T.STOPWORDS]
    out = {}
    for k, t in toks.items():
        tf = Counter(t)
        out[k] = round(sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in asked), 6)
    return [k for k, _ in sorted(out.items(), key=lambda x: (-x[1], x[0]))], out


def test_bm25_matches_brute_force_and_fills_with_zero_scores(spark, chunks, way):
    q = ["when does stoneware glaze melt", "tides and the moon moon", "honey frames of a colony", "nothing known here"]
    got = lexical.bm25(ask(spark, *q), chunks, 4).collect()
    texts = {c[0]: c[4] for c in CHUNKS}
    for i, text in enumerate(q):
        order, score = brute_bm25(text, texts)
        mine = sorted((r for r in got if r.qid == f"q{i}"), key=lambda r: r["rank"])
        assert [r.chunk_id for r in mine] == order[:4]
        assert [r.score for r in mine] == pytest.approx([score[r.chunk_id] for r in mine], abs=1e-6)


def test_full_text_needs_a_match(spark, chunks, way):
    got = lexical.full_text_or(ask(spark, "Where does a QUEEN lay eggs?", "which of these is it"), chunks.filter("paper_id <> 'kiln'"), 5)
    assert ids(got) == ["bees:00"] and ids(got, "q1") == []


def test_stems():
    """Pairs of the published vocabulary of the rules."""
    pairs = (
        "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consolation consol conspicuously conspicu "
        "conspiracy conspiraci conspirators conspir constancy constanc constant constant knack knack knackeries knackeri knightly knight knitted knit knives knive knocker knocker generate generat generously generous "
        "general general communities communiti arsenal arsenal skies sky dying die sky sky news news inning inning proceeding proceed tied tie cries cri ties tie gas gas kiwis kiwi gaps gap hopping hop hoped hope falling fall "
        "luxuriated luxuri saying say enjoy enjoy happy happi relational relat conditional condit probably probabl rationalization ration hopefulness hope electrical electr adoption adopt controlled control rolling roll by by cry cri triplicate triplic"
    ).split()
    assert [(w, stem(w)) for w in pairs[::2]] == [(w, s) for w, s in zip(pairs[::2], pairs[1::2])]


def brute_lexemes(text):
    return [stem(w) for w in re.findall("[a-z0-9]+", text.lower()) if w not in ENGLISH_STOP]


def test_stemmed_full_text_equals_brute_force(spark, chunks, way):
    q = ["Which queens were laying an egg?", "the of and", "printing tide table for a harbour, tides", "melted glazes"]
    got = lexical.full_text(ask(spark, *q), lexical.lexeme_store(chunks), 4)
    for i, text in enumerate(q):
        score = {c[0]: sum(w in set(brute_lexemes(text)) for w in brute_lexemes(c[4])) for c in CHUNKS}
        want = sorted(((-v, c) for c, v in score.items() if v))[:4]
        mine = [(-r.score, r.chunk_id) for r in got.filter(F.col("qid") == f"q{i}").orderBy("rank").collect()]
        assert mine == want
    assert ids(got)[0] == "bees:00" and ids(got, "q1") == [] and ids(got, "q3") == ["kiln:00"]


def test_covers_equal_all_minimal_intervals(spark):
    rng = np.random.default_rng(3)
    for _ in range(400):
        n, length = int(rng.integers(1, 4)), int(rng.integers(1, 14))
        text = rng.integers(0, n + 2, length).tolist()
        places = [[p for p, w in enumerate(text) if w == k] for k in range(n)]
        full = [(p, q) for p in range(length) for q in range(p, length) if set(range(n)) <= set(text[p : q + 1])]
        minimal = [(p, q, sum(w < n for w in text[p : q + 1])) for p, q in full if not any((a, b) != (p, q) and p <= a and b <= q for a, b in full)]
        assert lexical.covers(places) == minimal
    texts = {f"c{k:02d}": " ".join(rng.choice(["tide", "tides", "moon", "sand", "salt", "the"], int(rng.integers(1, 40)))) for k in range(60)}
    store = lexical.lexeme_store(spark.createDataFrame(list(texts.items()), "chunk_id string, text string").repartition(3))
    got = lexical.full_text_and(ask(spark, "the tide and moons", "salt", "tide glacier"), store, 8).orderBy("qid", "rank").collect()
    for qid, words in (("q0", ["moon", "tide"]), ("q1", ["salt"]), ("q2", ["tide", "glacier"])):
        score = {}
        for c, t in texts.items():
            lex = brute_lexemes(t)
            places = [[p for p, w in enumerate(lex) if w == x] for x in words]
            if all(places):
                score[c] = round(sum(0.1 / (1 + (q - p) - (sum(w in words for w in lex[p : q + 1]) - 1)) for p, q, _ in lexical.covers(places)), 9)
        assert [(r.chunk_id, r.score) for r in got if r.qid == qid] == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:8]


@pytest.fixture(params=[512, 0], ids=["one pass", "bounds"])
def way(request, monkeypatch):
    """Few questions are answered by a pass over all words, more by the block index: both ways give the same rows."""
    monkeypatch.setattr(lexical, "QUERY_BLOCK", max(request.param, 1))
    monkeypatch.setattr(lexical, "_few", lambda questions: request.param > 0)


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path, way):
    """Against brute force over all chunks, with repeated texts, ties and chunks that match nothing; most blocks stay unread."""
    rng = np.random.default_rng(4)
    topics = [[f"t{t}w{k}" for k in range(60)] for t in range(8)]
    texts = {}
    for i in range(600):
        words = topics[i * 7 % 8]
        texts[f"c{i:04d}"] = " ".join(rng.choice(words, 50, p=(w := 1.0 / np.arange(1, 61)) / w.sum())) if i % 9 else texts.get(f"c{i - 72:04d}", "odd one")
    data = spark.createDataFrame([(k, v) for k, v in texts.items()], "chunk_id string, text string").repartition(4)
    asked = [f"t{t}w{a} t{t}w{b} t{t}w{c} t{t}w0" for t, a, b, c in ((1, 50, 40, 3), (2, 9, 33, 58), (5, 20, 21, 22))] + ["odd one", "absent"]
    store, q = lexical.Store(data), ask(spark, *asked)
    got = lexical.bm25(q, store, 7).collect()
    for i, text in enumerate(asked):
        order, score = brute_bm25(text, texts)
        assert [r.chunk_id for r in sorted((r for r in got if r.qid == f"q{i}"), key=lambda r: r["rank"])] == order[:7]
    terms = lexical.query_terms(q).join(store.idf, "token").select("qid", "token", (F.col("qtf") * F.col("idf")).alias("w"))
    search = store.index.search(terms, 7)
    assert search.pairs.groupBy("qid").count().agg(F.max("count")).first()[0] < 0.5 * store.index.blocks.count()
    store.index.write(str(tmp_path / "index"))
    again = block_index.BlockIndex.read(spark, str(tmp_path / "index")).search(terms, 7).best()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, search.best().collect()))
    assert sum(r.n_tokens for r in store.index.blocks.collect()) == sum(len(t.split()) for t in texts.values())


def test_a_store_serves_several_retrievers(spark, chunks):
    store, q = lexical.Store(chunks), ask(spark, "neap tides in harbours", "wax cells")
    for k in (1, 3):
        assert lexical.bm25(q, store, k).collect() == lexical.bm25(q, chunks, k).collect()
    assert sorted(lexical.full_text_or(q, store, 5).collect()) == sorted(lexical.full_text_or(q, chunks, 5).collect())


def test_negative_weights_rank_below_no_match(spark, way):
    """In a corpus of three words that stand almost everywhere, the mean weight is negative and a match costs."""
    few = spark.createDataFrame([("a", "sand"), ("b", "sand salt"), ("c", "sand salt silt"), ("d", "salt silt sand"), ("e", "silt")], "chunk_id string, text string")
    got = lexical.bm25(ask(spark, "sand"), few, 5).orderBy("rank").collect()
    order, score = brute_bm25("sand", {r.chunk_id: r.text for r in few.collect()})
    assert [r.chunk_id for r in got] == order and [r.score for r in got] == pytest.approx([score[c] for c in order], abs=1e-6) and min(score.values()) < 0


def test_empty_inputs(spark, chunks, way):
    assert lexical.bm25(ask(spark, "tides").limit(0), chunks, 3).count() == 0
    assert lexical.bm25(ask(spark, "tides"), chunks.limit(0), 3).count() == 0
    assert lexical.full_text_or(ask(spark, ""), chunks, 3).count() == 0


def ranking(spark, *names):
    return spark.createDataFrame([("q0", n, i + 1) for i, n in enumerate(names)], "qid string, chunk_id string, rank int")


def test_fusion_and_rerank(spark, chunks):
    fused = fusion.reciprocal_rank_fusion([ranking(spark, "v", "u", "x", "y"), ranking(spark, "u", "v"), ranking(spark, "z")], 10)
    assert ids(fused) == ["u", "v", "z", "x", "y"]  # equal sums by id; a first place alone before a third and a fourth
    assert ids(fusion.reciprocal_rank_fusion([ranking(spark, "a", "b"), ranking(spark, "b", "a")], 1)) == ["a"]
    best = fusion.rerank(ask(spark, "the height of the water in every port"), chunks, ranking(spark, "kiln:00", "tide:01", "tide:02"), 2)
    assert ids(best) == ["tide:02", "kiln:00"]


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", None)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("q0", [1.0, 0.0])], "qid string, embedding array<float>")
    got = vectors.vector_topk(q, v, 5)
    none = vectors.vector_topk(q.limit(0), v, 5)
    assert none.count() == 0 and none.columns == got.columns
    assert ids(got) == ["a", "b"] and got.filter("chunk_id = 'b'").first().score == pytest.approx(0.6, abs=1e-6)
    import hashlib

    words = spark.createDataFrame([("alpha",), ("beta",)], "w string").select("w", vectors.hash_bucket(F.col("w"), 384).alias("b")).collect()
    assert all(r.b == int(hashlib.md5(r.w.encode()).hexdigest(), 16) % 384 for r in words)
    e = vectors.hash_embedding(spark.createDataFrame([(1, "x y x"), (2, "")], "id int, text string"), "id").collect()
    norm = {r.id: sum(x * x for x in r.embedding) for r in e}
    assert norm[1] == pytest.approx(1) and norm[2] == 0


def test_vector_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (300, 5)).astype(float)  # many equal cosines
    v[7] = 0
    rows = [(f"c{i:03d}", x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(20) if v[i].any()], "qid int, embedding array<float>")
    norm = np.sqrt((v * v).sum(axis=1))
    for block in (4096, 3):
        got = vectors.vector_topk(q, df, 6, block).collect()
        for i in range(20):
            mine = [(r.chunk_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == i]
            want = sorted(((round(float(v[i] @ v[j] / (norm[i] * norm[j])), 6), f"c{j:03d}") for j in range(300) if norm[j] > 0), key=lambda x: (-x[0], x[1]))[:6] if norm[i] > 0 else []
            assert mine == [(c, pytest.approx(s, abs=1e-6)) for s, c in want]


def test_windows_overlap_exactly(spark):
    words = [f"w{i}" for i in range(95)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short one"), (3, ""), (4, None)], "doc_id long, text string")
    got = chunking.chunk_texts(docs, size=40, overlap=10).orderBy("chunk_id").collect()
    first = [r.text.split() for r in got if r.doc_id == 1]
    assert [len(f) for f in first] == [40, 40, 35] and all(a[-10:] == b[:10] for a, b in zip(first, first[1:]))
    assert [r.doc_id for r in got if r.doc_id != 1] == [2]


def test_evidence(spark, chunks):
    e = spark.createDataFrame(
        [("q", 1, "kiln", "once the kiln passes twelve-hundred"), ("q", 2, "kiln", "a quote that this text never had"), ("q", 3, "loom", "once the kiln passes"), ("q", 4, "tide", "printed tables give the height of the water for every ship"), ("q", 5, "bees", "«»")],
        "qid string, ev int, paper_id string, quote string",
    )
    found = evidence.resolve(e, chunks)
    assert {(r.ev, r.chunk_id, r.whole) for r in found.collect()} == {(1, "kiln:00", True), (4, "tide:02", False), (5, "bees:00", True), (5, "bees:01", True)}
    problems = {r.ev: r.problem for r in evidence.unresolved(e, chunks, found).collect()}
    assert set(problems) == {2, 3} and "not in the corpus" in problems[3]


def test_quotes_of_any_length_are_found_anywhere(spark, chunks):
    quotes = ["printed tables give the height of the water for every port", "Neap TIDES leave shallow", "moon", "x", "wax", "é", "never written", "of", "e", None]
    asked = spark.createDataFrame([(i, 1, q) for i, q in enumerate(quotes)], "qid int, ev int, quote string")
    got = {(r.qid, r.chunk_id) for r in evidence.resolve_anywhere(asked, chunks).collect()}
    bare = {c[0]: "".join(x for x in c[4].lower() if x.isascii() and x.isalnum()) for c in CHUNKS}
    want = {(i, c) for i, q in enumerate(quotes) if q is not None for c, t in bare.items() if "".join(x for x in q.lower() if x.isascii() and x.isalnum()) in t}
    assert got == want and len(want) > 15


def test_papers_of_ranked_chunks(spark, chunks):
    got = evidence.with_papers(ranking(spark, "tide:02", "bees:01"), chunks).orderBy("rank").collect()
    assert [r.paper_id for r in got] == ["tide", "bees"]
    with pytest.raises(Exception, match="no such chunk: moon:00"):
        evidence.with_papers(ranking(spark, "moon:00"), chunks).collect()


def test_pages_are_repaired(spark):
    pages = spark.createDataFrame([("d", 1, "first page words " * 5), ("d", 2, "a sentence that runs over the page and ends with more words before it breaks"), ("d", 3, "right here and then goes on")], "doc_id string, page int, text string")
    e = spark.createDataFrame(
        [("a", 1, "d", "first page words first", 1), ("b", 1, "d", "runs over the page and ends with more words before it breaks right here and then", 1), ("c", 1, "d", "never written anywhere", 2), ("e", 1, "x", "no such document here", 1)],
        "qid string, ev int, paper_id string, quote string, page int",
    )
    got = {r.qid: (r.page, r.note) for r in evidence.fix_pages(e, pages).collect()}
    assert got["a"] == (1, None) and got["b"][0] == 2 and "1 -> 2" in got["b"][1] and "not found" in got["c"][1] and got["e"] == (1, None)


def test_metric_columns(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["c", "x"], ["p", "q"], ["q"])], "r array<string>, g array<string>, p array<string>, d array<string>")
    row = df.select(
        metrics.recall_at_k(F.col("r"), F.col("g"), 3).alias("recall"), metrics.recall_at_k(F.col("r"), F.col("g"), 2).alias("recall2"), metrics.hit_at_k(F.col("r"), F.col("g"), 3).alias("hit"),
        metrics.first_relevant_rank(F.col("r"), F.col("g")).alias("rank"), metrics.reciprocal_rank(F.col("r"), F.col("g")).alias("rr"), metrics.wrong_paper_rate(F.col("p"), F.col("d"), 5).alias("wrong"),
        metrics.citation_precision(F.array().cast("array<string>"), F.col("g")).alias("none"),
    ).first()
    assert (row.recall, row.recall2, row.hit, row["rank"], row.rr, row.wrong, row.none) == (0.5, 0.0, 1.0, 3, pytest.approx(1 / 3), 0.5, 0.0)
    with pytest.raises(Exception, match="empty gold"):
        df.select(metrics.recall_at_k(F.col("r"), F.array().cast("array<string>"), 3)).collect()


def test_nearest_rank(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "v")
    percents = {"a": 0, "b": 50, "c": 95, "d": 100, "e": 33.4}
    assert list(ranks.nearest_ranks(df, [], "v", percents).first()) == [1, 50, 95, 100, 34]
    assert list(ranks.nearest_ranks(df.limit(0), [], "v", percents).first()) == [None] * 5
    rng = np.random.default_rng(4)
    rows = [(["x", "y", None][int(k)], int(v) if v > 0 else None) for k, v in zip(rng.choice(3, 500, p=[0.9, 0.07, 0.03]), rng.integers(-2, 40, 500))]
    got = {r.g: tuple(r)[1:] for r in ranks.nearest_ranks(spark.createDataFrame(rows, "g string, v int").repartition(7), ["g"], "v", percents).collect()}
    for g in ("x", "y", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == tuple(v[max(1, math.ceil(q / 100 * len(v))) - 1] for q in percents.values())
    many = ranks.numbered(spark.range(1000).selectExpr("id * 7 % 1000 AS k").repartition(6), ["k"])
    assert many.filter("i <> k").count() == 0 and many.count() == 1000


def test_evaluation_of_a_fixed_ranking(spark):
    shown = {"plain": ["kiln:00", "bees:01", "tide:02", "tide:00", "bees:00", "tide:01"], "other": ["tide:01"]}
    rows = [("run", q, n, n.split(":")[0], i + 1) for q, names in shown.items() for i, n in enumerate(names)]
    rankings = spark.createDataFrame(rows, "retriever string, qid string, chunk_id string, paper_id string, rank int")
    resolved = spark.createDataFrame([("plain", 1, "tide:02"), ("plain", 2, "tide:01"), ("other", 1, "bees:00")], "qid string, ev int, chunk_id string")
    q = spark.createDataFrame([("plain", "cross_paper", 2, ["bees"]), ("other", "factual", 1, [])], "qid string, kind string, n_evidence int, distractors array<string>")
    per = metrics.question_metrics(rankings, resolved, q)
    assert {(r.qid, r.recall, r["rank"], r.wrong) for r in per.collect()} == {("plain", 0.5, 3, 0.4), ("other", 0.0, None, None)}  # the sixth place is too low for recall
    total = metrics.ablation(per).filter("kind IS NULL").first()
    assert (total.n, total.recall_at_5, total.mrr_at_10, total.wrong_paper_at_5) == (2, 0.25, pytest.approx(1 / 6, abs=1e-6), 0.4)


def test_bootstrap_is_repeatable(spark):
    d = spark.createDataFrame([(i, float(i % 2)) for i in range(40)], "qid int, delta double")
    a, b = metrics.bootstrap_ci(d, samples=400).first(), metrics.bootstrap_ci(d, samples=400).first()
    assert a == b and a["mean"] == 0.5 and 0.3 < a.low < 0.5 < a.high < 0.7
    assert metrics.bootstrap_ci(d.limit(0)).count() == 0


def _peak(run):
    """MB of arrays at the peak of a run (Arrow's own memory isn't counted)."""
    import tracemalloc

    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run())
        return rows, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


class Sent:
    def __init__(self, value):
        self.value = value


def test_vectors_of_a_full_batch_are_compared_in_parts():
    rng = np.random.default_rng(0)
    q, v = rng.standard_normal((4096, 16)), rng.standard_normal((10_000, 16))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.ListArray.from_arrays(pa.array(np.arange(10_001) * 16, pa.int32()), pa.array(v.ravel()))], ["chunk_id", "embedding"])
    rows, peak = _peak(lambda: vectors._best(Sent((pa.array(np.arange(4096)), q)), 10)([batch, batch.slice(0, 0), batch.slice(5000)]))
    assert rows >= 40_960 and peak < 200


def test_words_of_a_full_batch_are_scored_in_parts():
    n, words = 10_000, 40
    texts = pa.array([f"w{i % 97}" for i in range(n * words)])
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i:05d}" for i in range(n)]), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * words, pa.int32()), texts)], ["chunk_id", "tokens"])
    qids, terms = pa.array([f"q{i}" for i in range(2600)]), pa.array([f"w{i}" for i in range(100)])
    asker = np.arange(2600)
    sent = Sent((qids, terms, np.searchsorted(np.sort(asker % 100), np.arange(101)), asker[np.argsort(asker % 100, kind="stable")], np.ones(2600)))
    rows, peak = _peak(lambda: lexical._best(sent, 10, 40.0)([batch]))
    assert rows == 26_000 and peak < 150


def test_questions_are_not_met_by_a_broadcast_vocabulary(spark):
    store = lexical.Store(spark.createDataFrame([(1, "kelp and sand"), (2, "sand")], "chunk_id long, text string"))
    found = store.index.search(spark.createDataFrame([(7, "kelp", 1.0)], "qid long, token string, w double"), 2)
    for df in (found.others, found.scores):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.qid, r.chunk_id) for r in found.best().collect()] == [(7, 1)]


def test_few_questions_are_answered_without_a_block_index(spark):
    store = lexical.Store(spark.createDataFrame([(1, "kelp and sand"), (2, "sand sand")], "chunk_id long, text string"))
    asked = spark.createDataFrame([(7, "kelp")], "qid long, question string")
    assert [(r.chunk_id, r.rank) for r in lexical.bm25(asked, store, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert [r.chunk_id for r in lexical.full_text_or(asked, store, 2).collect()] == [1]
    assert "index" not in vars(store)
    assert {r.token: r.df for r in store.freq.collect()} == {"kelp": 1, "sand": 2}


def test_postings_of_keyed_chunks_are_counted_where_they_are_read(spark):
    data = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["a"])], "chunk_id long, tokens array<string>")
    found = lexical.postings(data, keyed=True)
    assert sorted(map(tuple, found.collect())) == [(1, "a", 1), (1, "b", 2), (3, "a", 1)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_postings_tf_adds_up_documents_that_share_an_id(spark, tmp_path):
    from sparkquill.plans import catalog

    docs = [(1, "sand kelp sand"), (1, "kelp"), (2, "sand"), (None, "wax"), (None, "wax"), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(map(tuple, catalog.postings_tf(spark, str(tmp_path)).collect()))
    assert [(int(c.split(":")[0]) if c.split(":")[0].isdigit() else None, t, n) for c, t, n in found if "null" not in c] == [(1, "kelp", 2), (1, "sand", 2), (2, "sand", 1)]
    assert [(t, n) for c, t, n in found if "null" in c] == [("wax", 2)]


@pytest.mark.parametrize("held", [1 << 19, 1], ids=["one pass", "a pass for each block"])
def test_many_questions_are_answered_without_a_block_index(spark, monkeypatch, held):
    """Blocks of three questions; words that many ask for are summed up as a matrix, the others one by one, and batches end inside a task."""
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)
    monkeypatch.setattr(lexical, "KEPT", held, raising=False)
    monkeypatch.setattr(lexical, "DENSE", 2, raising=False)
    monkeypatch.setitem(vars(lexical), "ROWS", 4)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    texts = {f"c{i:03d}": " ".join(rng.choice(words, int(rng.integers(1, 30)), p=(w := 1.0 / np.arange(1, 41)) / w.sum())) for i in range(90)}
    texts |= {f"d{i:03d}": texts[f"c{i:03d}"] for i in range(30)}  # ties, in other batches
    asked = [" ".join(rng.choice(words, 4)) for _ in range(8)] + ["absent", "w0 w0 w1"]
    store, q = lexical.Store(spark.createDataFrame([(k, "odd", v) for k, v in texts.items()], "chunk_id string, paper_id string, text string").repartition(3)), ask(spark, *asked)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, plain = lexical.bm25(q, store, 5).collect(), lexical.full_text_or(q, store, 5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for i, text in enumerate(asked):
        order, _ = brute_bm25(text, texts)
        assert [r.chunk_id for r in sorted((r for r in got if r.qid == f"q{i}"), key=lambda r: r["rank"])] == order[:5]
        score = {c: float(sum(w in text.split() for w in t.split())) for c, t in texts.items()}
        want = sorted(((-v, c) for c, v in score.items() if v))[:5]
        assert [(-r.score, r.chunk_id) for r in sorted((r for r in plain if r.qid == f"q{i}"), key=lambda r: r["rank"])] == want
    assert "index" not in vars(store)


def test_a_task_returns_its_best_chunks_once():
    """Not those of each batch: what a pass writes doesn't grow with the chunks of a task."""
    texts = pa.ListArray.from_arrays(pa.array(np.arange(901), pa.int32()), pa.array(["kelp"] * 900))
    whole = pa.RecordBatch.from_arrays([pa.array([f"{i:03d}" for i in range(900)][::-1]), texts], ["chunk_id", "tokens"])
    sent = Sent((pa.array(["q0", "q1"]), pa.array(["kelp"]), np.array([0, 2]), np.array([0, 1]), np.ones(2)))
    found = [r for b in lexical._best(sent, 4, None)([whole.slice(lo, 90) for lo in range(0, 900, 90)]) for r in b.to_pylist()]
    assert sorted((r["qid"], r["chunk_id"]) for r in found) == [(q, f"{i:03d}") for q in ("q0", "q1") for i in range(4)]


def test_a_store_keeps_the_papers_of_its_chunks(spark, chunks):
    store = lexical.Store(chunks, keep=("paper_id",))
    assert [r.paper_id for r in evidence.with_papers(ranking(spark, "tide:02", "bees:01"), store.tokens).orderBy("rank").collect()] == ["tide", "bees"]


def test_draws_of_the_bootstrap_are_not_shuffled(spark, monkeypatch):
    """Whatever the size of a table that is broadcast unasked; values beyond SENT come in parts."""
    d = spark.createDataFrame([(i, float(i * 7 % 5)) for i in range(40)], "qid int, delta double")
    want = metrics.bootstrap_ci(d, samples=300).first()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = metrics.bootstrap_ci(d, samples=300)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.first() == want
        monkeypatch.setattr(metrics, "SENT", 17)
        assert metrics.bootstrap_ci(d, samples=300).first() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tasks_give_back_what_arrow_has_freed(monkeypatch):
    given = []
    monkeypatch.setattr(lexical.T, "give_back", lambda: given.append(1), raising=False)
    texts = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["kelp and sand"])], ["doc_id", "_t"])
    words = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([["kelp", "sand"]])], ["chunk_id", "tokens"])
    sent = Sent((pa.array(["q0"]), pa.array(["kelp"]), np.array([0, 1]), np.array([0]), np.ones(1)))
    for rows in (chunking._windows(300, 50)([texts]), lexical._freq_rows([words.select(["tokens"])]), lexical._best(sent, 4, None)([words])):
        assert [b.num_rows for b in rows]
    assert len(given) == 3
