"""Regression gate, gold-set composition and label review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ---- fixed values: the notes of a review ----

REVIEWER, FLAGGED = "Reviewer: ", "Reviewer flagged this for a fix."


def regression_failures(current: DataFrame, baseline: DataFrame, margins: DataFrame) -> DataFrame:
    """metric, reason of the metrics that fell more than their margin below the baseline, or are missing now.

    current, baseline: metric, value; margins: metric, margin. Metrics without baseline or that begin with '_' are skipped.
    """
    held = margins.filter(~F.startswith("metric", F.lit("_"))).join(baseline.select("metric", F.col("value").alias("base")), "metric")
    met = held.join(current.select("metric", F.col("value").alias("now")), "metric", "left")
    floor = F.col("base") - F.col("margin")
    return met.filter(F.col("now").isNull() | (F.col("now") < floor)).select(
        "metric",
        F.when(F.col("now").isNull(), F.lit("missing from current run")).otherwise(F.format_string("%.3f < %.3f (baseline %.3f - margin %.3f)", "now", floor, "base", "margin")).alias("reason"),
    )


def composition(gold: DataFrame) -> DataFrame:
    """kind, total, verified, drafts."""
    return gold.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "draft").alias("drafts"))


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def scored_questions(gold: DataFrame, include_drafts: bool = False) -> DataFrame:
    """Answerable, verified (or drafts too), not a template."""
    return gold.filter((F.col("kind") != "unanswerable") & (F.lit(include_drafts) | (F.col("status") == "verified")) & ~F.startswith("id", F.lit("tmpl-")))


def select_questions(gold: DataFrame, include_drafts: bool = False, limit: int = 0, position: str = "file_pos") -> DataFrame:
    """Verified (or drafts too), not a template, the first `limit` in file order; 0 means all."""
    chosen = gold.filter((F.lit(include_drafts) | (F.col("status") == "verified")) & ~F.startswith("id", F.lit("tmpl-")))
    return chosen.orderBy(position).limit(limit) if limit else chosen


def first_seen(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with their first position, in that order."""
    return df.groupBy(value).agg(F.min(position).alias(position)).orderBy(position, value)


def question_problem() -> Column:
    """The invariant that a gold row breaks, or null."""
    evidence, unanswerable = F.coalesce(F.size("evidence"), F.lit(0)), F.col("kind") == "unanswerable"
    papers = F.transform("evidence", lambda e: e["paper_id"])
    distractors = F.coalesce("distractor_paper_ids", F.array().cast("array<string>"))
    return (
        F.when(unanswerable & (evidence > 0), F.lit("unanswerable question with evidence"))
        .when(~unanswerable & (evidence <= 0), F.lit("answerable question without evidence"))
        .when(F.exists("evidence", lambda e: F.length(e["quote"]) < 20), F.lit("quote shorter than 20 characters"))
        .when(F.exists("evidence", lambda e: e["page"] < 1), F.lit("page below 1"))
        .when((F.col("kind") == "cross_paper") & (F.size(distractors) == 0), F.lit("cross-paper question without distractors"))
        .when(F.arrays_overlap(distractors, papers), F.lit("a distractor is a gold paper"))
    )


def invalid_questions(gold: DataFrame) -> DataFrame:
    """id, problem of gold rows that break an invariant."""
    return gold.select("id", question_problem().alias("problem")).filter("problem IS NOT NULL")


def invalid_responses(responses: DataFrame) -> DataFrame:
    """qid, problem: answered needs an answer and a citation, refused needs a reason."""
    problem = (
        F.when((F.col("status") == "answered") & (F.coalesce("answer", F.lit("")) == ""), F.lit("answered without an answer"))
        .when((F.col("status") == "answered") & (F.coalesce(F.size("citations"), F.lit(0)) <= 0), F.lit("answered without a citation"))
        .when((F.col("status") == "refused") & (F.coalesce("refusal_reason", F.lit("")) == ""), F.lit("refused without a reason"))
        .when(~F.col("status").isin("answered", "refused"), F.lit("unknown status"))
    )
    return responses.select("qid", problem.alias("problem")).filter("problem IS NOT NULL")


def apply_reviews(gold: DataFrame, reviews: DataFrame) -> DataFrame:
    """gold (id, question, reference_answer, status, notes) with review verdicts (id, status, question, answer, comment): rejected rows go, verified ones are marked, needs_fix adds a note; edits count where not blank and different. Column `action` tells what happened."""
    r = reviews.select("id", F.coalesce("status", F.lit("draft")).alias("_verdict"), F.trim(F.coalesce("question", F.lit(""))).alias("_q"), F.trim(F.coalesce("answer", F.lit(""))).alias("_a"), F.trim(F.coalesce("comment", F.lit(""))).alias("_c"))
    j = gold.join(r, "id", "left").filter(F.coalesce(F.col("_verdict") != "rejected", F.lit(True)))
    new_q = (F.col("_q") != "") & (F.col("_q") != F.col("question"))
    new_a = (F.col("_a") != "") & (F.col("_a") != F.coalesce("reference_answer", F.lit("")))
    note = F.when(F.col("_c") != "", F.concat(F.lit(REVIEWER), "_c")).otherwise(F.lit(FLAGGED))
    return j.select(
        "id",
        F.when(new_q, F.col("_q")).otherwise(F.col("question")).alias("question"),
        F.when(new_a, F.col("_a")).otherwise(F.col("reference_answer")).alias("reference_answer"),
        F.when(F.col("_verdict") == "verified", F.lit("verified")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("_verdict") == "needs_fix", F.concat_ws(" | ", F.nullif("notes", F.lit("")), note)).otherwise(F.col("notes")).alias("notes"),
        F.coalesce(F.when(F.col("_verdict").isin("verified", "needs_fix"), F.col("_verdict")), F.when(new_q | new_a, F.lit("edited")), F.lit("unchanged")).alias("action"),
    )
