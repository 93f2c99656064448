"""Text files as numbered lines, and JSON lines whose errors say where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquill.operators import gate
from sparkquill.sources.readers import CHUNK, GOLD
from sparkquill.staging import staged

# fixed values: the kinds of gold questions and the states of their labels
KINDS = ("factual", "unanswerable", "cross_paper")
STATUSES = ("verified", "draft")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), value of every line of the files, blank ones too.

    Files are split anywhere: a split's lines are counted, sums over the splits before it in its file give its first number, and a row adds its place in
    the split. Rows of one split stand together in the order they were read in, so a place is a difference of row numbers; the lines are staged, for numbers and
    counts to be of the same reading.
    """
    m = F.col("_metadata")
    read = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("_start"), F.monotonically_increasing_id().alias("_at"), "value")
    lines = staged(read, "lines")
    splits = lines.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    order = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    return lines.join(before, ["file", "_start"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "value")


def read_json_lines(spark: SparkSession, path: str, schema: str, problem: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of JSON lines with their file and line_no, and the problems: file, line_no, reason.

    A line is a problem if it isn't an object, has a value of another type than the schema's, or if `problem`, a column over the schema's names, is not null. Blank lines are neither.
    """
    lines = read_lines(spark, path).filter("trim(value) <> ''")
    wider = f"{schema}, _corrupt string"
    parsed = lines.withColumn("_row", F.from_json("value", wider, {"columnNameOfCorruptRecord": "_corrupt"}))
    flat = parsed.select("file", "line_no", "_row.*")
    other = F.lit(None).cast("string") if problem is None else problem
    flat = flat.withColumn("_reason", F.when(F.col("_corrupt").isNotNull(), F.lit("not a row of the schema")).otherwise(other)).drop("_corrupt")
    return flat.filter("_reason IS NULL").drop("_reason"), flat.filter("_reason IS NOT NULL").select("file", "line_no", F.col("_reason").alias("reason"))


def _missing(*names: str) -> Column:
    return F.coalesce(*[F.when(F.col(n).isNull(), F.lit(f"no {n}")) for n in names])


def chunk_problem() -> Column:
    return F.coalesce(_missing("chunk_id", "paper_id", "section", "page", "text"), F.when(F.col("page") < 1, F.lit("a page below 1")))


def gold_problem() -> Column:
    """Why a line can't be a gold question, or null: fields that it must have, its kind and status, then the invariants of `gate.question_problem`."""
    return F.coalesce(
        _missing("id", "question", "kind"),
        F.when(~F.col("kind").isin(*KINDS), F.concat(F.lit("no such kind: "), "kind")),
        F.when(~F.col("status").isin(*STATUSES), F.concat(F.lit("no such status: "), "status")),
        F.when(F.exists("evidence", lambda e: e["paper_id"].isNull() | e["quote"].isNull() | e["page"].isNull()), F.lit("evidence without paper_id, page or quote")),
        gate.question_problem(),
    )


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a key but its first, by file and line."""
    placed = rows.select("file", "line_no", key)
    first = placed.groupBy(key).agg(F.min(F.struct("file", "line_no")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    later = placed.join(first, key).filter(F.struct("file", "line_no") != F.col("f"))
    return later.select("file", "line_no", F.concat(F.lit(f"{key} "), F.col(key), F.lit(" stands in "), "f.file", F.lit(":"), F.col("f.line_no").cast("string"), F.lit(" already")).alias("reason"))


def gold_with_problems(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Gold questions of JSON lines and all problems of the files; of an id that occurs twice the first line stays."""
    rows, problems = read_json_lines(spark, path, GOLD, gold_problem())
    rows = rows.withColumn("status", F.coalesce("status", F.lit("verified")))
    again = _repeated(rows, "id")
    return rows.join(again, ["file", "line_no"], "left_anti").drop("file", "line_no"), problems.unionByName(again)


def chunks_with_problems(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows, problems = read_json_lines(spark, path, CHUNK, chunk_problem())
    return rows.drop("file", "line_no"), problems


def read_gold_strict(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions; the first problem of the files, by file and line, is an error that names both."""
    rows, problems = gold_with_problems(spark, path)
    worst = problems.orderBy("file", "line_no").first()
    if worst is not None:
        raise ValueError(f"{worst['file']}:{worst['line_no']}: {worst['reason']}")
    return rows
