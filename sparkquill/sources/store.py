"""A chunk store as tables: upserts, stale rows, counts, and result writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.functions import text as T


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: list[str] | None = None) -> DataFrame:
    """`old` with the rows of `new` put in by key. Columns in keep_old take the old value where the new one is null; a column that only `old` has keeps its value."""
    keep_old = keep_old or []
    has_new = F.col("_new").isNotNull()
    joined = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full_outer")

    def value(c: str) -> Column:
        if c == key:
            return F.col(c)
        if c not in new.columns:
            return F.col(f"o.{c}").alias(c)
        if c in keep_old:
            return F.coalesce(f"n.{c}", f"o.{c}").alias(c)
        return F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*[value(c) for c in old.columns])


def stale(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `old` whose key `new` no longer has; an empty `new` makes all of them stale."""
    return old.join(new.select(key).distinct(), key, "left_anti")


def store_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.count("embedding").alias("n_embedded"))


def load(old: DataFrame, new: DataFrame, path: str, key: str = "chunk_id") -> DataFrame:
    """Writes the next version of the store to a new folder (readers switch to it as a whole) and returns it."""
    kept = old.join(new.select(key).distinct(), key, "left_semi")
    upsert(kept, new, key, ["embedding"] if "embedding" in old.columns else []).write.parquet(path)
    return old.sparkSession.read.parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", True).json(path)


def log_line(responses: DataFrame) -> DataFrame:
    """One JSON event for each response."""
    return responses.select(F.to_json(F.struct(F.lit("ask").alias("event"), *[F.col(c) for c in responses.columns])).alias("value"))


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """A Markdown table's lines, in order: numbers with three decimals, null as a dash."""
    cells = [T.fmt(F.col(c)) if kind in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("–")) for c, kind in df.select(*columns).dtypes]
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "n long, line string")
    body = df.select((F.monotonically_increasing_id() + 2).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return head.unionByName(body).orderBy("n").select("line")
