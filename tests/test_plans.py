import pytest
from pyspark.sql import functions as F

from sparkquill.operators import answers, metrics, vectors
from sparkquill.plans.retrievers import Corpus

CHUNKS = [("fern:1", "fern", "Spores", 1, "ferns drop spores from the underside of a frond"), ("moss:1", "moss", "Walls", 2, "moss drinks rain through its leaves on old stone"), ("vine:1", "vine", "Grapes", 3, "pruned in winter it fruits on new wood")]


@pytest.fixture(scope="module")
def corpus(spark):
    c = spark.createDataFrame(CHUNKS, "chunk_id string, paper_id string, section string, page int, text string")
    e = vectors.hash_embedding(c, "chunk_id")
    c = c.join(e, "chunk_id").withColumn("embedding_header", F.col("embedding"))
    return Corpus(c, spark.createDataFrame([("vine", "A year in the vineyard")], "paper_id string, title string"))


def test_every_retriever_runs(spark, corpus):
    q = spark.createDataFrame([("q0", "where do ferns drop their spores")], "qid string, question string")
    q = q.join(vectors.hash_embedding(q, "qid", "question"), "qid").cache()
    found = corpus.retrievers()
    assert len(found) == 9
    for name, run in found.items():
        top = run(q, 2).orderBy("rank").collect()
        assert top[0].chunk_id == "fern:1" and len(top) <= 2, name
    with pytest.raises(ValueError, match="unknown retriever: nope"):
        corpus.retrievers(["nope"])


def test_headers_change_what_is_found(spark, corpus):
    q = spark.createDataFrame([("q0", "a year in the vineyard")], "qid string, question string")
    some = corpus.retrievers(["bm25", "bm25_header"])
    assert some["bm25_header"](q, 1).first().chunk_id == "vine:1" and some["bm25"](q, 1).first().score == 0.0


CITE = "array<struct<paper_id:string,section:string,page:int,chunk_id:string,quote:string>>"
RESPONSE = f"qid string, status string, citations {CITE}, dropped_citations int, latency_ms double, input_tokens int, output_tokens int, estimated_cost_usd double, error string"


def test_answers_are_scored(spark):
    """Six questions: right, falsely refused, distractor cited, refused, falsely answered, failed."""
    def cite(p, page=1):
        return [(p, "s", page, f"{p}:0", "a quote")]

    ev = [("p", 1, "q")]
    gold = spark.createDataFrame([(i, k, e) for i, k, e in (("a", "factual", ev), ("b", "factual", ev), ("c", "cross_paper", ev), ("d", "unanswerable", []), ("e", "unanswerable", []), ("f", "factual", ev))], "qid string, kind string, evidence array<struct<paper_id:string,page:int,quote:string>>")
    rows = [("a", "answered", cite("p")), ("b", "refused", []), ("c", "answered", cite("x")), ("d", "refused", []), ("e", "answered", cite("p"))]
    responses = spark.createDataFrame([(*r, 0, 10.0, 100, 20, 0.002, None) for r in rows] + [("f", None, None, None, None, None, None, None, "TimeoutError")], RESPONSE)
    resolved = spark.createDataFrame([(i, "p:0") for i in "abcf"], "qid string, chunk_id string")
    judged = spark.createDataFrame([(i, 0.75, 0.0075, None) for i in "ac"] + [("e", None, None, "bad reply")], "qid string, faithfulness double, judge_cost_usd double, judge_error string")
    results = answers.answer_results(gold, responses, resolved, judged).cache()
    s = metrics.summarize_answers(results).first()
    assert (s.n_questions, s.n_errors, s.n_answerable, s.n_unanswerable) == (6, 2, 3, 2)
    assert (s.refusal_accuracy, s.false_answer_rate, s.citation_precision, s.citation_hit_rate, s.wrong_paper_citation_rate, s.faithfulness) == (0.6, 0.5, 0.5, 0.5, 0.5, 0.75)
    assert s.false_refusal_rate == pytest.approx(1 / 3, abs=1e-6) and s.total_judge_cost_usd == 0.015
    by = {r.qid: r for r in results.collect()}
    assert by["a"].citation_precision_page == 1.0 and by["c"].citation_precision_page == 0.0 and by["e"].citation_precision is None and by["f"].error == "TimeoutError"
    kinds = {r.kind: r for r in metrics.summarize_answers(results, by_kind=True).collect()}
    assert kinds["cross_paper"].wrong_paper_citation_rate == 1.0
    shown = {r.metric: r.value for r in answers.summary_table(metrics.summarize_answers(results)).collect()}
    assert shown["refusal_accuracy"] == "0.600" and shown["n_questions"] == "6"
