"""Retrieval and answer metrics over rankings and gold sets, as grouped aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.operators.ranks import nearest_ranks, numbered

#: Values that are sent to all tasks at a time.
SENT = 500_000

# ---- per row, over arrays ----


def recall_at_k(ranking: Column, gold: Column, k: int) -> Column:
    """Share of the gold ids in the first k; an empty gold set is an error."""
    return F.when(F.size(gold) == 0, F.raise_error(F.lit("recall of an empty gold set")).cast("double")).otherwise(F.size(F.array_intersect(F.slice(ranking, 1, k), gold)) / F.size(gold))


def hit_at_k(ranking: Column, gold: Column, k: int) -> Column:
    return F.arrays_overlap(F.slice(ranking, 1, k), gold).cast("double")


def first_relevant_rank(ranking: Column, gold: Column) -> Column:
    """1-based, or null."""
    return F.nullif(F.array_position(F.transform(ranking, lambda r: F.array_contains(gold, r)), F.lit(True)), F.lit(0))


def reciprocal_rank(ranking: Column, gold: Column) -> Column:
    return F.coalesce(1.0 / first_relevant_rank(ranking, gold), F.lit(0.0))


def wrong_paper_rate(papers: Column, distractors: Column, k: int) -> Column:
    """Share of the rows returned (k at most) that come from distractors; 0 without rows."""
    top = F.slice(papers, 1, k)
    return F.coalesce(F.try_divide(F.size(F.filter(top, lambda p: F.array_contains(distractors, p))), F.size(top)), F.lit(0.0))


def citation_precision(cited: Column, gold: Column) -> Column:
    """Share of citations in the gold set, repeated ones counted each; 0 without any."""
    return F.coalesce(F.try_divide(F.size(F.filter(cited, lambda c: F.array_contains(gold, c))), F.size(cited)), F.lit(0.0))


# ---- over tables ----


def question_metrics(rankings: DataFrame, resolved: DataFrame, questions: DataFrame, k: int = 5, depth: int = 10) -> DataFrame:
    """retriever, qid, kind, recall (share of evidence quotes with a chunk in the first k), hit, rank (first gold), rr, wrong (cross-paper questions: share of distractors among the first k).

    rankings: retriever, qid, chunk_id, paper_id, rank. resolved: qid, ev, chunk_id. questions: qid, kind, distractors.
    Quotes that resolve to nothing still count in the recall's denominator through `n_evidence` of questions.
    """
    gold = resolved.select("qid", "chunk_id", "ev").distinct()
    hits = rankings.join(gold, ["qid", "chunk_id"], "left")
    by_evidence = hits.filter(F.col("ev").isNotNull() & (F.col("rank") <= k)).groupBy("retriever", "qid").agg(F.countDistinct("ev").alias("found"))
    flags = hits.join(questions.select("qid", "distractors"), "qid").groupBy("retriever", "qid").agg(
        F.min(F.when(F.col("ev").isNotNull() & (F.col("rank") <= depth), F.col("rank"))).alias("rank"),
        F.count_distinct(F.when(F.col("rank") <= k, F.col("rank"))).alias("shown"),
        F.count_distinct(F.when((F.col("rank") <= k) & F.array_contains("distractors", F.col("paper_id")), F.col("rank"))).alias("bad"),
    )
    names = rankings.select("retriever").distinct()
    base = questions.crossJoin(F.broadcast(names))  # a handful of retrievers
    return base.join(flags, ["retriever", "qid"], "left").join(by_evidence, ["retriever", "qid"], "left").select(
        "retriever", "qid", "kind",
        F.coalesce(F.try_divide(F.coalesce("found", F.lit(0)), F.col("n_evidence")), F.lit(0.0)).alias("recall"),
        F.col("rank").isNotNull().cast("double").alias("hit"),
        "rank",
        F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("rr"),
        F.when(F.col("kind") == "cross_paper", F.coalesce(F.try_divide("bad", "shown"), F.lit(0.0))).alias("wrong"),
    )


def ablation(per_question: DataFrame) -> DataFrame:
    """One row for each retriever and one for each retriever and kind (kind null: all), in one pass."""
    return per_question.rollup("retriever", "kind").agg(
        F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall_at_5"), F.round(F.avg("rr"), 6).alias("mrr_at_10"), F.round(F.avg("wrong"), 6).alias("wrong_paper_at_5")
    ).filter("retriever IS NOT NULL")


def summarize_answers(results: DataFrame, by_kind: bool = False) -> DataFrame:
    """Conditional means over answer rows; rows that failed before an answer existed aren't scored, those whose judge failed are.

    results: qid, kind, should_refuse, refused, citation_precision, citation_hit, wrong_paper_citation, faithfulness,
    dropped_citations, latency_ms, input_tokens, output_tokens, cost_usd, judge_cost_usd, error.
    """
    scored = F.col("error").isNull() | F.startswith("error", F.lit("judge failed"))
    answerable, unanswerable = scored & ~F.col("should_refuse"), scored & F.col("should_refuse")
    answered = answerable & ~F.col("refused")
    ok = F.col("error").isNull()

    def mean(value: Column, where: Column) -> Column:
        return F.round(F.avg(F.when(where, value.cast("double"))), 6)

    aggregates = [
        F.count("*").alias("n_questions"), F.count("error").alias("n_errors"), F.count_if(answerable).alias("n_answerable"), F.count_if(unanswerable).alias("n_unanswerable"),
        mean(F.col("refused") == F.col("should_refuse"), scored).alias("refusal_accuracy"), mean(F.col("refused"), answerable).alias("false_refusal_rate"),
        mean(~F.col("refused"), unanswerable).alias("false_answer_rate"), mean(F.col("citation_precision"), answered).alias("citation_precision"),
        mean(F.col("citation_hit"), answered).alias("citation_hit_rate"), mean(F.col("wrong_paper_citation"), answered).alias("wrong_paper_citation_rate"),
        mean(F.col("faithfulness"), scored).alias("faithfulness"), F.coalesce(F.sum(F.when(scored, F.col("dropped_citations"))), F.lit(0)).alias("citations_dropped_total"),
        mean(F.col("input_tokens"), ok).alias("mean_input_tokens"), mean(F.col("output_tokens"), ok).alias("mean_output_tokens"), mean(F.col("cost_usd"), ok).alias("mean_cost_usd"),
        F.round(F.coalesce(F.sum("judge_cost_usd"), F.lit(0.0)), 6).alias("total_judge_cost_usd"),
    ]
    groups = ["kind"] if by_kind else []
    latency = nearest_ranks(results.filter(ok).withColumn("latency_ms", F.col("latency_ms").cast("double")), groups, "latency_ms", {"latency_p50_ms": 50, "latency_p95_ms": 95})
    counts = results.groupBy(*groups).agg(*aggregates)
    if not by_kind:
        return counts.crossJoin(latency)  # a row each
    return counts.join(latency.withColumnRenamed("kind", "_kind"), F.col("kind").eqNullSafe(F.col("_kind")), "left").drop("_kind")


def bootstrap_ci(deltas: DataFrame, value: str = "delta", samples: int = 5000, seed: int = 7) -> DataFrame:
    """One row: mean, low and high end of the 95 % interval of the mean over resampled rows; no row for an empty table.

    deltas: one row for each question (qid). A resample draws n row numbers, in the order of qid, by md5, so equal inputs give equal
    intervals. The draws (n x samples) are generated in parallel and summed up within their tasks: the values are sent to them, SENT rows at a time, and no draw is shuffled.
    """
    rows = numbered(deltas.select("qid", F.col(value).cast("double").alias("v")), ["qid"])
    n = rows.count()
    digest = F.md5(F.concat_ws("|", F.lit(seed), "rep", "j").cast("binary"))
    draws = deltas.sparkSession.range(samples * n).select(F.expr(f"id div {max(n, 1)}").alias("rep"), F.expr(f"id % {max(n, 1)}").alias("j"))
    drawn = draws.select("rep", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(max(n, 1))).alias("i"))
    values = [rows] if n <= SENT else [rows.filter((F.col("i") >= lo) & (F.col("i") < lo + SENT)) for lo in range(0, n, SENT)]
    parts = [drawn.join(F.broadcast(x.select("i", "v")), "i").select("rep", "v") for x in values]
    means = reduce(DataFrame.unionByName, parts).groupBy("rep").agg(F.avg("v").alias("m"))  # `samples` rows
    ends = means.agg(F.expr("percentile(m, array(0.025, 0.975))").alias("p"), F.count("*").alias("k")).filter("k > 0")
    return ends.crossJoin(rows.agg(F.avg("v").alias("mean"))).select(
        F.round("mean", 6).alias("mean"), F.round(F.get("p", F.lit(0)), 6).alias("low"), F.round(F.get("p", F.lit(1)), 6).alias("high")
    )
