import json

import pytest
from pyspark.sql import functions as F

from sparkquill.operators import answers, documents, gate
from sparkquill.sources import readers, store

LINE = readers.LINE


def doc(spark, rows, name="d"):
    return spark.createDataFrame([(name, i, *r) for i, r in enumerate(rows)], LINE)


def body(text, page=1):
    return (text, page, 10.0, False, False)


def head(text, page=1, size=12.0, bold=True):
    return (text, page, size, bold, False)


def margin(text, page):
    return (text, page, 8.0, False, True)


HARBOUR = [
    margin("Harbour notes, sheet 1", 1), head("Background"), body("Ships wait for water."), margin("Harbour notes, sheet 2", 2), head("1 Overview of tides", 2), body("The sea leaves a high water-", 2), body("mark twice a day", 2),
    margin("Harbour notes, sheet 3", 3), body("and takes it back.", 3), margin("12", 3), head("2 Walls", 3), head("2.1 Sluices", 3), body("Gates hold the basin.", 3), margin("Harbour notes, sheet 4", 4), head("4 Dredging", 4), body("Silt goes out by barge.", 4),
    margin("Harbour notes, sheet 5", 5), head("Conclusion", 5), body("Keep the gates shut.", 5), head("Bibliography", 5), body("A pilot's almanac.", 5), head("B Soundings", 5), body("Nine fathoms.", 5),
]


def test_lines_become_sections_and_chunks(spark):
    lines = doc(spark, HARBOUR, "h")
    kept = documents.drop_running_lines(lines)
    assert kept.filter("in_margin").count() == 0 and kept.count() == len(HARBOUR) - 6
    sections = documents.split_sections(kept)
    found = [r.section for r in sections.select("section_no", "section").distinct().orderBy("section_no").collect()]
    assert found == ["Background", "1 Overview of tides", "2.1 Sluices", "4 Dredging", "Conclusion", "B Soundings"]  # "2 Walls" has no lines
    chunks = {r.chunk_id: r for r in documents.chunk_sections(sections).collect()}
    assert chunks["h:01-1-overview-of-tides:000"].text == "The sea leaves a high watermark twice a day and takes it back."
    assert {(k.split(":")[1], r.page) for k, r in chunks.items()} == {("00-background", 1), ("01-1-overview-of-tides", 2), ("02-2-1-sluices", 3), ("03-4-dredging", 4), ("04-conclusion", 5), ("05-b-soundings", 5)}
    words = [(r.word, r.page) for r in documents.section_words(sections).filter("section_no = 1").orderBy("pos").collect()]
    assert words[4:7] == [("high", 2), ("watermark", 2), ("twice", 2)] and words[-1] == ("back.", 3)
    stats = documents.ingest_stats(documents.ingest(lines, 5, 2)).first()
    assert (stats.sections, stats.chunks) == (6, 9)


def titles(spark, rows):
    s = documents.split_sections(doc(spark, rows))
    return [r.section for r in s.select("section_no", "section").distinct().orderBy("section_no").collect()]


def test_split_number_and_title_join(spark):
    assert titles(spark, [head("1"), head("Motivation"), body("a b c"), head("2"), head("Keels and ribs"), body("d e f"), head("3"), body("no title follows")]) == ["1 Motivation", "2 Keels and ribs"]


def test_roman_and_capital_headings(spark):
    assert titles(spark, [body("I. WINDS AND SAILS"), body("text here"), body("II. ROPES"), body("more"), body("BIBLIOGRAPHY"), body("a book")]) == ["I. Winds and sails", "II. Ropes"]


def test_numbers_must_run_in_order(spark):
    rows = [head("1 Institute of Naval History"), body("names"), head("1 Background and aims"), body("x"), head("8 Too far ahead"), body("y"), head("3 Masts"), body("z"), head("2 Behind"), body("w"), head("4 Anchors,"), body("v")]
    assert titles(spark, rows) == ["Front matter", "1 Background and aims", "3 Masts"]


def test_empty_lines_table(spark):
    assert documents.ingest(doc(spark, HARBOUR).limit(0)).count() == 0


RETRIEVED = [
    ("q", 1, "rye:04", "rye", "Dough", 12, "A sour starter is fed with rye flour and warm water on the evening before baking."), ("q", 2, "salt:01", "salt", "Crust", 30, "Steam in the first ten minutes keeps the crust soft, so that the loaf can rise."),
]


def held(spark):
    return spark.createDataFrame(RETRIEVED, "qid string, rank int, chunk_id string, paper_id string, section string, page int, text string")


def reply(spark, payload, truncated=False, qid="q"):
    return spark.createDataFrame([(qid, payload if isinstance(payload, str) else json.dumps(payload), 1000, 200, truncated)], "qid string, payload string, input_tokens int, output_tokens int, truncated boolean")


def verdicts(spark, citations):
    g = reply(spark, {"can_answer": True, "answer": "yes", "citations": citations})
    return [r.verdict for r in answers.check_citations(answers.parse_citations(g), held(spark)).orderBy("pos").collect()]


def test_citations(spark):
    good = {"source": 2, "quote": "keeps the crust soft"}
    listed = [{"source": 1, "quote": "fed with rye flour ... evening before baking"}, good, {"source": 2, "quote": "KEEPS the  crust, soft"}, {"source": 1, "quote": "keeps the crust soft"}, {"source": 1, "quote": "evening before baking … fed with rye flour"}, {"source": 2, "quote": "the loaf is made of gold"}, {"source": 2, "quote": "Steam"}]
    assert verdicts(spark, listed) == ["kept", "kept", "merged", "dropped", "dropped", "dropped", "dropped"]
    bad = [good | {"source": s} for s in (False, "2", 2.5, 0, 7, None)] + [{"source": 2, "quote": ["keeps the crust soft"]}, {"source": 2}, 17]
    assert verdicts(spark, bad) == ["dropped"] * 9
    assert verdicts(spark, "none") == [] and verdicts(spark, None) == []


def response(spark, payload, truncated=False, retrieved=True):
    g = reply(spark, payload, truncated)
    h = held(spark) if retrieved else held(spark).limit(0)
    return answers.build_responses(g, answers.check_citations(answers.parse_citations(g), h), h, 1.0, 5.0).first()


def test_responses(spark):
    good = {"source": 1, "quote": "fed with rye flour and warm water"}
    ok = response(spark, {"can_answer": True, "answer": " with flour and water ", "citations": [good, {"source": 9, "quote": "out of thin air, this one"}]})
    assert (ok.status, ok.answer, ok.citations[0].chunk_id, ok.citations[0].page, ok.refusal_reason, ok.dropped_citations, ok.dropped_quotes) == ("answered", "with flour and water", "rye:04", 12, None, 1, ["out of thin air, this one"])
    assert ok.estimated_cost_usd == pytest.approx((1000 * 1.0 + 200 * 5.0) / 1e6) and ok.retrieved_chunk_ids == ["rye:04", "salt:01"]
    assert response(spark, {"can_answer": True, "answer": "bread", "citations": []}).refusal_reason == answers.UNVERIFIED
    assert response(spark, {"can_answer": 1, "answer": "bread", "citations": [good]}).status == "refused"
    assert response(spark, {"can_answer": False, "refusal_reason": "nothing on cakes"}).refusal_reason == "nothing on cakes"
    assert response(spark, {}, truncated=True).refusal_reason == answers.CUT_OFF
    assert response(spark, {"can_answer": False}).refusal_reason == answers.UNSUPPORTED
    assert response(spark, {"can_answer": True, "answer": "bread", "citations": [good]}, retrieved=False).status == "refused"


def test_faithfulness_and_spot_check(spark):
    c = spark.createDataFrame([("a", [(True,), (False,), (True,), (True,)]), ("b", [])], "qid string, claims array<struct<supported:boolean>>")
    assert {r.qid: r.faithfulness for r in answers.faithfulness(c).collect()} == {"a": 0.75, "b": None}
    r = spark.range(100).select(F.col("id").cast("string").alias("qid"))
    assert answers.spot_check(r, 5, 1).collect() == answers.spot_check(r, 5, 1).collect()
    m = answers.render_sources(held(spark), spark.createDataFrame([("salt", "Salt and steam")], "paper_id string, title string")).first().message
    assert m.startswith("[1] rye, Dough, page 12\nA sour") and "\n\n[2] Salt and steam, Crust, page 30\n" in m


def test_gate(spark):
    def t(**v):
        return spark.createDataFrame([(k, float(x)) for k, x in v.items()] or [("zz", 0.0)], "metric string, value double")

    margins = spark.createDataFrame([("recall", 0.02), ("new", 0.02), ("_meta", 0.0)], "metric string, margin double")
    assert gate.regression_failures(t(recall=0.80), t(recall=0.85), margins).count() == 1
    assert gate.regression_failures(t(recall=0.84, new=0.1), t(recall=0.85), margins).count() == 0
    assert gate.regression_failures(t(other=1), t(recall=0.85, _meta=1), margins).first().reason == "missing from current run"


GOLD = "id string, question string, kind string, status string, evidence array<struct<paper_id:string,page:int,quote:string>>, reference_answer string, distractor_paper_ids array<string>, notes string"


def test_gold_and_reviews(spark):
    quote = ("p", 1, "a quote that is long enough")
    gold = spark.createDataFrame(
        [("a", "qa", "factual", "draft", [quote], None, [], None), ("b", "qb", "factual", "draft", [quote], None, [], None), ("c", "qc", "unanswerable", "verified", [quote], None, [], "old"), ("d", "qd", "cross_paper", "verified", [quote], None, ["p"], None), ("tmpl-1", "t", "factual", "verified", [quote], None, [], None)],
        GOLD,
    )
    reviews = spark.createDataFrame([("a", "verified", "edited", None, None), ("b", "rejected", None, None, None), ("c", "needs_fix", None, None, "look")], "id string, status string, question string, answer string, comment string")
    got = {r.id: r for r in gate.apply_reviews(gold, reviews).collect()}
    assert set(got) == {"a", "c", "d", "tmpl-1"} and got["a"].question == "edited" and got["a"].status == "verified" and got["c"].notes == "old | Reviewer: look" and got["d"].action == "unchanged"
    assert {r.id for r in gate.scored_questions(gold).collect()} == {"d"} and {r.id for r in gate.scored_questions(gold, True).collect()} == {"a", "b", "d"}
    assert {r.id: r.problem for r in gate.invalid_questions(gold).collect()} == {"c": "unanswerable question with evidence", "d": "a distractor is a gold paper"}


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", "t1", [1.0]), ("b", "t2", [2.0]), ("c", "t3", None)], "chunk_id string, text string, embedding array<float>")
    new = spark.createDataFrame([("a", "t1b", None), ("d", "t4", [4.0])], "chunk_id string, text string, embedding array<float>")
    got = {r.chunk_id: (r.text, r.embedding) for r in store.load(old, new, str(tmp_path / "v2")).collect()}
    assert got == {"a": ("t1b", [1.0]), "d": ("t4", [4.0])}
    assert {r.chunk_id for r in store.stale(old, new, "chunk_id").collect()} == {"b", "c"}
    assert tuple(store.store_stats(old).first()) == (3, 2)
    table = [r.line for r in store.markdown_rows(spark.createDataFrame([("m", 0.5, None)], "name string, v double, w double"), ["name", "v", "w"]).collect()]
    assert table == ["| name | v | w |", "|---|---|---|", "| m | 0.500 | – |"]
    assert json.loads(store.log_line(spark.createDataFrame([("q", 1)], "qid string, n int")).first().value) == {"event": "ask", "qid": "q", "n": 1}


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id":"a","paper_id":"p","section":"s","page":1,"text":"t"}\n\n')
    assert readers.read_chunks(spark, str(tmp_path / "c.jsonl")).first().chunk_id == "a"
    (tmp_path / "bad.jsonl").write_text('{"chunk_id":"a","paper_id":"p","section":"s","page":0,"text":"t"}\n')
    with pytest.raises(Exception, match="invalid chunk"):
        readers.read_chunks(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "g.jsonl").write_text('{"id":"q1","question":"x","kind":"factual"}\n{"id":"q1","question":"y","kind":"factual"}\n')
    with pytest.raises(Exception, match="duplicate question id"):
        readers.read_gold(spark, str(tmp_path / "g.jsonl")).collect()
    (tmp_path / "m.json").write_text('{"recall": 0.7, "note": "text", "mrr": 0.5}')
    assert {r.metric: r.value for r in readers.read_metrics(spark, str(tmp_path / "m.json")).collect()} == {"recall": 0.7, "mrr": 0.5}
    (tmp_path / "r.json").write_text('{"q1": {"status": "verified", "comment": "ok"}}')
    assert readers.read_reviews(spark, str(tmp_path / "r.json")).first().status == "verified"
    (tmp_path / "p.yaml").write_text('# papers\npapers:\n  - id: rye\n    title: "Rye breads"\n    group: a\n  - id: salt\n    title: Salt: a study\n')
    assert {r.paper_id: r.title for r in readers.read_manifest(spark, str(tmp_path / "p.yaml")).collect()} == {"rye": "Rye breads", "salt": "Salt: a study"}
    v = spark.createDataFrame([([1.0, 2.0],)], "e array<float>")
    assert readers.vector_width(v, "e", 2).count() == 1
    with pytest.raises(Exception, match="has 2 values, not 3"):
        readers.vector_width(v, "e", 3).collect()


def test_html_lines_keep_headings(spark):
    html = "<html><head><title>T</title><style>p{}</style></head><body><h1 class='a'>Big <i>words</i></h1><p>one<br>two</p><h3>Small</h3><!-- <p>no</p> --><div>three</div></body></html>"
    pages = spark.createDataFrame([(5, html), (6, None), (7, "")], "page_id long, html string")
    got = [(r.doc_id, r.text, r["size"], r.bold) for r in readers.html_lines(pages).orderBy("doc_id", "line_no").collect()]
    assert got == [("5", "T", 10.0, False), ("5", "Big words", 22.0, True), ("5", "one", 10.0, False), ("5", "two", 10.0, False), ("5", "Small", 18.0, True), ("5", "three", 10.0, False)]


def test_settings(tmp_path):
    from sparkquill.session import Settings

    (tmp_path / ".env").write_text("# a comment\nSPARKQUILL_TOP_K=7\nSPARKQUILL_RETRIEVER='bm25'\nOTHER=1\n")
    s = Settings.load({"SPARKQUILL_TOP_K": "9", "SPARKQUILL_PRICE_IN": "0.5"}, str(tmp_path / ".env"))
    assert (s.top_k, s.retriever, s.price_in, s.chunk_size) == (9, "bm25", 0.5, 300)
    assert Settings.load({}) == Settings() and s.depth(0) == s.depth(None) == 9 and s.depth(3) == 3
    with pytest.raises(ValueError):
        Settings.load({"SPARKQUILL_TOP_K": "many"})


def test_first_seen_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4), ("c", 2)], "v string, pos int")
    assert [(r.v, r.pos) for r in gate.first_seen(df, "v", "pos").collect()] == [("b", 1), ("a", 2), ("c", 2), (None, 4)]


def test_conversations_as_papers_equal_their_sql(spark, tmp_path):
    """Lines that could be halves of headings ("A." before a short line, "A." last before the references), lines in capitals, and more than 19 questions."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    rows = [(1, 0, "user", "Is this so?"), (1, 1, "assistant", "It is.\nA.\nIs.\n3 WINDS AND SAILS\nREFERENCES\nMore of it.\nA.")]
    rows += [(2, t, "assistant" if t % 2 else "user", f"Text of turn {t}.") for t in range(46)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("section_split", "section_chunks", "ingest_counts"):
        mine = entry.queries()[name](spark, str(tmp_path))
        theirs = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(tuple(map(str, r)) for r in mine.collect()) == sorted(tuple(map(str, r)) for r in theirs), name
