"""Queries whose rows have been through files: versioned stores, JSON lines, reports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.functions import text as T
from sparkquill.operators import answers, metrics
from sparkquill.plans.catalog import QUERIES, _gold, _versions, chunks, query, questions, table
from sparkquill.plans.recorded import _judged, _responses, pairs
from sparkquill.sources import lines, readers, store
from sparkquill.sources.versions import VersionedStore
from sparkquill.staging import new_path

__all__ = ["QUERIES"]

BUCKETS = 16
BROKEN = '{"id": "broken'


@query
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three versions of a store: two thirds of the documents, the even ones put in, and these alone."""
    old, new = _versions(spark, sf_dir)
    held = VersionedStore(spark, new_path(spark, "store"))
    held.create(old, "doc_id", BUCKETS)
    held.merge(new, keep_old=("embedding",))
    held.merge(new, keep_old=("embedding",), complete=True)
    out = [held.read(v).select(F.lit(v).alias("version"), "doc_id", "lang", "embedding") for v in held.versions()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _gold_file(spark: SparkSession, sf_dir: str) -> str:
    """Gold questions as JSON lines, with lines that are cut off, without evidence, with short quotes, of unknown kinds, and repeated ids."""
    n = F.col("file_pos")
    quote = F.when(n % 7 == 0, F.lit("too short")).otherwise(F.lit("a quote of more than twenty characters"))
    evidence = F.array(F.struct(F.col("id").alias("paper_id"), F.lit(1).alias("page"), quote.alias("quote")))
    kind = F.when(n % 13 == 0, F.lit("odd")).otherwise(F.col("kind"))
    given = F.when((F.col("kind") == "factual") & (n % 11 != 0), evidence)
    gold = _gold(spark, sf_dir).select(F.when(n % 19 == 0, F.lit("same")).otherwise(F.col("id")).alias("id"), "question", kind.alias("kind"), F.when((n % 2 == 0) & (n % 19 != 0), F.col("status")).alias("status"), given.alias("evidence"), "file_pos")
    whole = F.to_json(F.struct(*[c for c in gold.columns if c != "file_pos"]))
    path = new_path(spark, "gold")
    gold.select(F.when(n % 5 == 0, F.lit(BROKEN)).otherwise(whole).alias("value")).write.text(path)
    return path


@query
def gold_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back of a file of gold questions: the statuses of those that are sound, and the problems by reason."""
    rows, problems = lines.gold_with_problems(spark, _gold_file(spark, sf_dir))
    reason = F.regexp_replace("reason", "stands in .*", "stands in a line already")
    sound = rows.groupBy(F.concat(F.lit("sound, "), F.col("status")).alias("what")).agg(F.count("*").alias("n"))
    return sound.unionByName(problems.groupBy(reason.alias("what")).agg(F.count("*").alias("n")))


@query
def chunk_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, written as JSON lines and read back."""
    path = new_path(spark, "chunks")
    store.write_jsonl(chunks(spark, sf_dir).select("chunk_id", "paper_id", "section", "page", "text"), path)
    rows, _ = lines.chunks_with_problems(spark, path)
    return rows.select("chunk_id", "paper_id", "section", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean length of each source's documents as a JSON object of metrics (its keys are the sources), read back."""
    means = table(spark, sf_dir, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.round(F.avg("n_chars"), 3).alias("mean"))
    path = new_path(spark, "metrics")
    means.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "mean")))).alias("value")).write.text(path)
    return readers.read_metrics(spark, path)


@query
def review_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of labels as JSON objects by id, one for some hundred of them, read back."""
    n = F.col("file_pos")
    review = F.struct(F.when(n % 3 == 0, F.lit("rejected")).otherwise(F.lit("verified")).alias("status"), F.when(n % 5 == 0, F.lit("edited")).alias("question"), F.when(n % 7 == 0, F.lit("look \"again\"")).alias("comment"))
    each = _gold(spark, sf_dir).select("id", review.alias("r"))
    path = new_path(spark, "reviews")
    parts = 1 + each.count() // 500  # an object stays small, the parts grow with the table
    each.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "r")))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_reviews(spark, path).select("id", "status", "question", "answer", "comment")


@query
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown lines of counts, mean lengths and shares by source."""
    docs = table(spark, sf_dir, "documents")
    by = docs.groupBy("source").agg(F.count("*").alias("documents"), F.avg(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars"))).alias("mean_chars"), T.fmt(F.avg((F.col("lang") == "en").cast("double")), percent=True).alias("english"))
    return store.markdown_rows(by, ["source", "documents", "mean_chars", "english"])


@query
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of a summary row: lengths of the documents."""
    docs = table(spark, sf_dir, "documents")
    return answers.summary_table(docs.agg(F.count("*").alias("n_documents"), F.avg("n_chars").alias("mean_chars"), F.avg(F.when(F.col("doc_id") < 0, F.lit(1.0))).alias("no_such")))


@query
def ask_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON event for each response."""
    return store.log_line(_responses(spark, sf_dir).select("qid", "status", "dropped_citations", "input_tokens", "output_tokens"))


@query
def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as two embedders are given them."""
    q = F.col("question")
    return questions(spark, sf_dir).select("qid", F.md5(T.query_text(q, "BAAI/bge-small-en").cast("binary")).alias("prefixed"), F.md5(T.query_text(q, "other").cast("binary")).alias("plain"))


@query
def array_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, hits and reciprocal ranks over arrays: the parts of an order's lines, in order, against those it has more than 25 of."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("ranking"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("gold")
    ).filter("size(gold) > 0")
    r, g = F.col("ranking"), F.col("gold")
    return per.select("l_orderkey", F.round(metrics.recall_at_k(r, g, 2), 6).alias("recall"), metrics.hit_at_k(r, g, 2).alias("hit"), F.round(metrics.reciprocal_rank(r, g), 6).alias("rr"))


@query
def spot_check_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty judged answers for a person to mark (the limit is the feature), with their passages."""
    p = pairs(spark, sf_dir)
    cited = _responses(spark, sf_dir).select("qid", "answer", F.transform("citations", lambda c: c["chunk_id"]).alias("cited_chunk_ids"))
    judged = _judged(p)
    results = cited.join(judged, "qid").join(answers.faithfulness(judged), "qid")
    held = p.select(F.explode(F.array(F.struct(F.concat("qid", F.lit(":1")).alias("chunk_id"), F.col("u").alias("text")), F.struct(F.concat("qid", F.lit(":2")).alias("chunk_id"), F.col("g").alias("text")))).alias("c")).select("c.*")
    return answers.spot_check_passages(results, held, 20, seed=3).select("pick", "qid", "answer", "faithfulness", "cited_passages")
