"""The registered queries over the star-schema and document tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.functions import text as T
from sparkquill.operators import chunking, evidence, fusion, gate, lexical, metrics, ranks, vector_index, vectors
from sparkquill.operators import documents as D
from sparkquill.sources import readers, store
from sparkquill.staging import spread, staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIM = 64


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- shared inputs ----


def _cut(docs: DataFrame) -> DataFrame:
    cut = chunking.chunk_texts(docs, keep=("source", "lang"))
    return cut.select("chunk_id", F.col("doc_id").cast("string").alias("paper_id"), F.col("source").alias("section"), "lang", (F.col("n") + 1).alias("page"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, paper_id (the document), section (its source), text."""
    return _cut(spread(table(spark, sf_dir, "documents")))


def asked_chunks(spark: SparkSession, sf_dir: str, evidence_: DataFrame) -> DataFrame:
    """The chunks of the papers that are asked for; documents are looked up by their ids before they are cut. Staged: the evidence operators read them more than once."""
    papers = staged(evidence_.select(F.col("paper_id").alias("_asked")).distinct(), "papers")
    papers = papers.hint("broadcast" if papers.count() <= evidence.SENT else "merge")
    docs = spread(table(spark, sf_dir, "documents"))
    return staged(_cut(docs.join(papers, docs["doc_id"].cast("string") == papers["_asked"], "left_semi")), "chunks")


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_texts(spread(table(spark, sf_dir, "documents"))).select("chunk_id", "text")


def _headed(c: DataFrame) -> DataFrame:
    return c.select("chunk_id", T.with_header(F.col("lang"), F.col("paper_id"), F.col("section"), F.col("text")).alias("text"))


def header_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headed(chunks(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts of the benchmark's items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def store_of(chunks_: DataFrame) -> lexical.Store:
    return lexical.Store(chunks_)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence: passages of 90 characters, one for every 700 of the whole text of every document whose id is divisible by 20, asked of their own document."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0")
    cut = docs.select("doc_id", T.normalize(F.col("text")).alias("t")).filter("t <> ''")
    each = cut.select("doc_id", F.explode(F.sequence(F.lit(1), F.ceil(F.length("t") / 700).cast("int"))).alias("ev"), "t")
    return each.select(F.col("doc_id").alias("qid"), "ev", F.col("doc_id").cast("string").alias("paper_id"), F.substr("t", (F.col("ev") - 1) * 700 + 1, F.lit(90)).alias("quote")).filter(F.length("quote") >= 20)


# ---- text ----


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query
def squash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.squash(F.col("text")).alias("squashed"))


@query
def slug_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.upper("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_title(F.concat(F.lit("3 "), title, F.lit("."))).alias("title"), T.clean_title(F.col("p_name")).alias("plain"))


@query
def tokenize_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokenize(F.col("text"))).alias("n_tokens"), F.array_join(F.slice(T.tokenize(F.col("text")), 1, 10), " ").alias("first_tokens"))


@query
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_chunks(spark, sf_dir)


# ---- inverted index ----


@query
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a document that is alone with its doc_id have ids of their own; only the others' words are shuffled."""
    docs = spread(table(spark, sf_dir, "documents"))
    again = staged(table(spark, sf_dir, "documents").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again")), "again")
    if again.isEmpty():
        return lexical.postings(lexical.tokens(chunking.chunk_texts(docs)), keyed=True)
    once, often = (lexical.tokens(chunking.chunk_texts(docs.join(again, docs["doc_id"].eqNullSafe(again["again"]), how))) for how in ("left_anti", "left_semi"))
    return lexical.postings(once, keyed=True).unionByName(lexical.postings(often))


@query
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.doc_freq(lexical.tokens(plain_chunks(spark, sf_dir)))


@query
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(lexical.tokens(plain_chunks(spark, sf_dir))).select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


@query
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenized = lexical.tokens(plain_chunks(spark, sf_dir))
    return lexical.idf(lexical.doc_freq(tokenized), lexical.corpus_stats(tokenized)).select("token", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(questions(spark, sf_dir), plain_chunks(spark, sf_dir), 10)


@query
def bm25_header_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(questions(spark, sf_dir), header_chunks(spark, sf_dir), 10)


@query
def fts_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.full_text_or(questions(spark, sf_dir), plain_chunks(spark, sf_dir), 10)


@query
def fts_stemmed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full text as the default configuration has it: stems of English words, any of them, by cover density."""
    return lexical.full_text(questions(spark, sf_dir), lexical.lexeme_store(plain_chunks(spark, sf_dir)), 10)


def _words_at_places(text):
    return T.words(F.coalesce(text, F.lit("")))


@query
def fts_cover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two first words in order of each item's distinct words of eight letters or more: chunks with both, by cover density; places count all words."""
    words = F.array_sort(F.array_distinct(F.filter(T.words(F.col("question")), lambda w: F.length(w) >= 8)))
    asked = questions(spark, sf_dir).select("qid", F.array_join(F.slice(words, 1, 2), " ").alias("question"))
    return lexical.full_text_and(asked, lexical.Store(plain_chunks(spark, sf_dir), tokenizer=_words_at_places), 10)


# ---- vectors ----


def _vector_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), v.select(F.col("vec_id").alias("chunk_id"), "embedding")


@query
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_topk(*_vector_sides(spark, sf_dir), 10)


@query
def vector_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = readers.vector_width(table(spark, sf_dir, "embeddings"), "embedding", DIM)
    return checked.groupBy("label").agg(F.count("embedding").alias("n"), F.min(F.size("embedding")).alias("width"), F.round(F.avg(vectors.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"))


@query
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `vector_topk` through the index."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return vector_index.VectorIndex(v.select(F.col("vec_id").alias("chunk_id"), "embedding")).search(asked, 10)[0]


@query
def hash_embed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors.hash_embedding(questions(spark, sf_dir), "qid", "question", DIM)
    c = vectors.hash_embedding(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id", "text", DIM)
    return vectors.vector_topk(q, c.filter(F.exists("embedding", lambda x: x != 0)), 10)


@query
def hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", vectors.hash_bucket(F.col("word"), 384).alias("bucket"))


# ---- fusion ----


def _two_lexical(q: DataFrame, plain: DataFrame, headed: DataFrame | None = None) -> list[DataFrame]:
    store = store_of(plain)
    return [lexical.bm25(q, store if headed is None else store_of(headed), fusion.POOL), lexical.full_text_or(q, store, fusion.POOL)]


@query
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(_two_lexical(questions(spark, sf_dir), plain_chunks(spark, sf_dir)), 10)


@query
def hybrid_header_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = staged(chunks(spark, sf_dir), "chunks")  # both stores read them
    return fusion.reciprocal_rank_fusion(_two_lexical(questions(spark, sf_dir), c, _headed(c)), 10)


@query
def hybrid_rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = questions(spark, sf_dir), staged(plain_chunks(spark, sf_dir), "chunks")  # the reranking reads the texts again
    return fusion.rerank(q, c, fusion.reciprocal_rank_fusion(_two_lexical(q, c), fusion.RERANK_POOL), 10)


@query
def hybrid_vector_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default retriever: BM25 over chunks with headers, fused with the nearest hashed embeddings of the same texts."""
    q, headed = questions(spark, sf_dir), header_chunks(spark, sf_dir)
    asked = vectors.hash_embedding(q, "qid", "question", DIM)
    held = vectors.hash_embedding(headed, "chunk_id", "text", DIM).filter(F.exists("embedding", lambda x: x != 0))
    return fusion.reciprocal_rank_fusion([lexical.bm25(q, headed, fusion.POOL), vectors.vector_topk(asked, held, fusion.POOL)], 10)


# ---- evidence ----


@query
def evidence_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = staged(quotes(spark, sf_dir), "quotes")
    return evidence.resolve(asked, asked_chunks(spark, sf_dir, asked))


@query
def evidence_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with a wrong end: only their first characters are found."""
    asked = staged(quotes(spark, sf_dir).withColumn("quote", F.concat("quote", F.lit(" and so forth"))), "quotes")
    return evidence.resolve(asked, asked_chunks(spark, sf_dir, asked)).filter(~F.col("whole")).select("qid", "ev", "chunk_id")


def _shifted_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some quotes asked of another paper, some of a paper that doesn't exist."""
    own, next_ = F.col("qid").cast("string"), (F.col("qid") + 1).cast("string")
    return quotes(spark, sf_dir).withColumn("paper_id", F.when(F.col("ev") == 2, F.lit("none")).when(F.col("ev") == 3, next_).otherwise(own))


@query
def evidence_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = staged(_shifted_quotes(spark, sf_dir), "quotes")
    held = asked_chunks(spark, sf_dir, asked)
    return evidence.unresolved(asked, held, evidence.resolve(asked, held))


@query
def evidence_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.lit(1).alias("ev"), F.col("text").alias("quote"))
    return evidence.resolve_anywhere(asked, plain_chunks(spark, sf_dir))


@query
def evidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = staged(quotes(spark, sf_dir).withColumn("page", F.lit(1)), "quotes")
    pages = asked_chunks(spark, sf_dir, asked).select(F.col("paper_id").alias("doc_id"), F.col("page").cast("int").alias("page"), "text")
    return evidence.fix_pages(asked, pages).select("qid", "ev", "page", "note")


# ---- metrics ----


def _own_questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions made of the quotes, what they resolve to, and two rankings."""
    asked = staged(quotes(spark, sf_dir), "quotes")
    q = asked.groupBy("qid").agg(F.min_by("quote", "ev").alias("question"), F.count("*").alias("n_evidence"))
    q = q.withColumn("kind", F.when(F.col("qid") % 100 == 0, F.lit("cross_paper")).otherwise(F.lit("factual"))).withColumn("distractors", F.array(F.col("qid").cast("string")))
    q = staged(q, "questions")
    resolved = staged(evidence.resolve(asked, asked_chunks(spark, sf_dir, asked)).select("qid", "ev", "chunk_id"), "resolved")
    store = lexical.Store(chunks(spark, sf_dir), keep=("paper_id",))  # the documents are cut once for all that follows
    ranked = [
        lexical.bm25(q.select("qid", "question"), store, 10).withColumn("retriever", F.lit("bm25")),
        lexical.full_text_or(q.select("qid", "question"), store, 10).withColumn("retriever", F.lit("fts")),
    ]
    rankings = ranked[0].select("retriever", "qid", "chunk_id", "rank").unionByName(ranked[1].select("retriever", "qid", "chunk_id", "rank"))
    return q, resolved, staged(evidence.with_papers(rankings, store.tokens), "rankings")  # the metrics read both several times


def _per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, resolved, rankings = _own_questions(spark, sf_dir)
    return metrics.question_metrics(rankings, resolved, q)


@query
def question_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _per_question(spark, sf_dir)
    return p.select("retriever", "qid", "kind", F.round("recall", 6).alias("recall"), "hit", F.col("rank").cast("double").alias("rank"), F.round("rr", 6).alias("rr"), F.round("wrong", 6).alias("wrong"))


@query
def retriever_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ablation(_per_question(spark, sf_dir))


@query
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _per_question(spark, sf_dir)
    deltas = p.groupBy("qid").agg((F.sum(F.when(F.col("retriever") == "bm25", F.col("recall"))) - F.sum(F.when(F.col("retriever") == "fts", F.col("recall")))).alias("delta"))
    return metrics.bootstrap_ci(deltas)


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.nearest_ranks(table(spark, sf_dir, "events"), ["event_type"], "value", {f"p{q}": q for q in (0, 50, 95, 100)})


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer rows made of order lines: what an evaluation run would have recorded."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") == "P").alias("should_refuse"), (F.col("o_custkey") % 5 == 0).alias("refused"),
        F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 4) / 4.0).alias("citation_precision"), (F.col("o_custkey") % 3 == 0).alias("citation_hit"), (F.col("o_custkey") % 11 == 0).alias("wrong_paper_citation"),
        F.when(F.col("o_custkey") % 13 != 0, (F.col("o_custkey") % 8) / 8.0).alias("faithfulness"), (F.col("o_custkey") % 2).alias("dropped_citations"), F.col("o_totalprice").alias("latency_ms"),
        (F.col("o_custkey") * 3).alias("input_tokens"), F.col("o_custkey").alias("output_tokens"), T.cost_usd(F.col("o_custkey") * 3, F.col("o_custkey"), 1.0, 5.0).alias("cost_usd"), F.lit(0.0075).alias("judge_cost_usd"),
        F.when(F.col("o_custkey") % 17 == 0, F.lit("judge failed: timeout")).when(F.col("o_custkey") % 19 == 0, F.lit("pipeline failed")).alias("error"),
    )


@query
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summarize_answers(_answers(spark, sf_dir))


@query
def answer_summary_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summarize_answers(_answers(spark, sf_dir), by_kind=True).select("kind", "n_questions", "n_errors", "refusal_accuracy", "citation_precision", "wrong_paper_citation_rate", "faithfulness")


@query
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price by return flag and status against that of the first half of the orders."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("metric"), "l_quantity", "l_orderkey")
    current = lines.groupBy("metric").agg(F.avg("l_quantity").alias("value"))
    baseline = lines.filter("l_orderkey % 2 = 0").groupBy("metric").agg(F.avg("l_quantity").alias("value"))
    margins = current.select("metric", F.lit(0.0).alias("margin"))
    return gate.regression_failures(current, baseline, margins).select("metric")


# ---- store, gold, review, answers ----


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 3 <> 0").select("doc_id", "lang", F.col("n_chars").cast("double").alias("embedding"))
    new = docs.filter("doc_id % 2 = 0").select("doc_id", F.upper("lang").alias("lang"), F.when(F.col("doc_id") % 4 == 0, F.lit(-1.0)).alias("embedding"))
    return old, new


@query
def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*_versions(spark, sf_dir), "doc_id", ["embedding"])


@query
def stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return store.stale(old, new, "doc_id").select("doc_id")


@query
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents; those whose id is divisible by 4 have a vector."""
    docs = table(spark, sf_dir, "documents")
    return store.store_stats(docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit(-1.0)).alias("embedding")))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select(
        F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("tmpl-"), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("toxic") == 1, F.lit("unanswerable")).otherwise(F.lit("factual")).alias("kind"), F.when(F.col("quality") == 1, F.lit("verified")).otherwise(F.lit("draft")).alias("status"),
        F.concat(F.lit("question "), F.col("doc_id")).alias("question"), F.lit(None).cast("string").alias("reference_answer"), F.when(F.col("doc_id") % 2 == 0, F.lit("old note")).alias("notes"), F.col("doc_id").alias("file_pos"),
    )


@query
def gold_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.composition(_gold(spark, sf_dir))


@query
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.duplicate_ids(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query
def scored_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.scored_questions(_gold(spark, sf_dir)).select("id")


@query
def apply_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir)
    n = F.col("file_pos")
    reviews = gold.filter(n % 3 != 0).select(
        "id", F.when(n % 4 == 0, F.lit("rejected")).when(n % 4 == 1, F.lit("verified")).when(n % 4 == 2, F.lit("needs_fix")).otherwise(F.lit("draft")).alias("status"),
        F.when(n % 5 == 0, F.lit(" edited question ")).alias("question"), F.when(n % 7 == 0, F.lit("an answer")).alias("answer"), F.when(n % 8 == 2, F.lit("look again")).alias("comment"),
    )
    return gate.apply_reviews(gold, reviews).select("id", "question", "reference_answer", "status", "notes", "action")


@query
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one site (five of them make a document): the first and last two lines of each page are its margin."""
    from pyspark.sql import Window

    lines = readers.html_lines(table(spark, sf_dir, "pages"))
    at, back = Window.partitionBy("doc_id").orderBy("line_no"), Window.partitionBy("doc_id").orderBy(F.desc("line_no"))
    placed = lines.withColumn("in_margin", (F.row_number().over(at) <= 2) | (F.row_number().over(back) <= 2))
    placed = placed.withColumn("number", F.col("doc_id").cast("long")).withColumn("doc_id", F.expr("CAST(number div 5 AS STRING)")).withColumn("page", F.expr("CAST(number % 5 + 1 AS INT)")).drop("number")
    return D.drop_running_lines(placed).groupBy("doc_id").agg(F.count("*").alias("kept"), F.count_if("in_margin").alias("kept_margin"))


@query
def spotcheck_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkquill.operators.answers import spot_check

    return spot_check(_answers(spark, sf_dir), 20, seed=3).select("qid", "refused", "faithfulness")
