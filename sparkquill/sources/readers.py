"""Sources with declared schemas: chunks, gold questions, manifests, metrics, reviews, and lines of paged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_id string, paper_id string, section string, page int, text string"
GOLD = "id string, question string, kind string, status string, evidence array<struct<paper_id:string,page:int,quote:string>>, reference_answer string, distractor_paper_ids array<string>, notes string"
PAPER = "paper_id string, title string, arxiv_id string, venue string, grp string"
REVIEW = "map<string,struct<status:string,question:string,answer:string,comment:string>>"
LINE = "doc_id string, line_no int, text string, page int, size double, bold boolean, in_margin boolean"


def _checked(df: DataFrame, problem, message: str) -> DataFrame:
    first = df.columns[0]
    return df.withColumn(first, F.when(problem, F.raise_error(F.concat(F.lit(message), F.col(first)))).otherwise(F.col(first)))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; a row that doesn't parse, has no id or a page below 1 is an error."""
    df = spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path)
    return _checked(df, F.coalesce(F.col("page") < 1, F.lit(True)) | F.col("text").isNull(), "invalid chunk: ")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions; status is 'verified' by default, and an id that occurs twice is an error."""
    df = spark.read.schema(GOLD).option("mode", "FAILFAST").json(path).withColumn("status", F.coalesce("status", F.lit("verified")))
    twice = df.groupBy("id").count().filter("count > 1").withColumn("_twice", F.lit(True)).select("id", "_twice")
    return _checked(df.join(twice, "id", "left"), F.col("_twice").isNotNull(), "duplicate question id: ").drop("_twice")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of numbers as rows (metric, value); other values are left out."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("metric", "v")).select("metric", F.col("v").try_cast("double").alias("value")).filter("value IS NOT NULL")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", REVIEW)).alias("id", "r")).select("id", "r.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A flat YAML list of papers ("- key: value" and "key: value" lines) as rows."""
    from pyspark.sql import Window

    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    pair = r"^\s*(?:-\s+)?([A-Za-z_]+):\s*(.*?)\s*$"
    kept = lines.filter(F.col("line").rlike(pair) & ~F.col("line").rlike(r"^\s*#"))
    item = F.sum(F.col("line").rlike(r"^\s*-\s").cast("int")).over(Window.partitionBy(F.lit(0)).orderBy("n"))  # one small file
    fields = kept.select(item.alias("item"), F.regexp_extract("line", pair, 1).alias("k"), F.regexp_replace(F.regexp_extract("line", pair, 2), r"^[\"']|[\"']$", "").alias("v")).filter("item > 0")
    rows = fields.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return rows.select(F.col("m")["id"].alias("paper_id"), F.col("m")["title"].alias("title"), F.col("m")["arxiv"].alias("arxiv_id"), F.col("m")["venue"].alias("venue"), F.col("m")["group"].alias("grp"))


WIDTH = "vector_width"  # the key of a column's metadata, which Spark keeps in the schema of the files


def with_width(df: DataFrame, column: str, width: int) -> DataFrame:
    """`df` with the width in the column's metadata: tables written from it tell their width without a scan. Rows of another width are an error."""
    return _each_width(df, column, width).withMetadata(column, {WIDTH: width})


def kept_width(df: DataFrame, column: str) -> int | None:
    return df.schema[column].metadata.get(WIDTH)


def vector_width(df: DataFrame, column: str, width: int) -> DataFrame:
    """`df`, with an error where a vector of the column has another width: at once if the schema keeps the width, else from the rows."""
    kept = kept_width(df, column)
    if kept is None:
        return _each_width(df, column, width)
    if kept != width:
        raise ValueError(f"{column} holds vectors of {kept} values, not {width}")
    return df


def _each_width(df: DataFrame, column: str, width: int) -> DataFrame:
    return df.withColumn(column, F.when(F.size(column) != width, F.raise_error(F.format_string("a vector of " + column + " has %d values, not " + str(width), F.size(column))).cast(df.schema[column].dataType)).otherwise(F.col(column)))


_BLOCK = r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|td|th|table|br|section|article|nav|header|footer|title|body|html|head)\b[^>]*>"


def html_lines(pages: DataFrame) -> DataFrame:
    """Block-level texts of HTML pages as lines (page 1); tags, scripts and comments are dropped. Headings h1 to h6 are bold and of 22 to 12 points, other lines of 10."""
    bare = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    blocks = F.split(F.regexp_replace(bare, r"(?i)(<h([1-6])\b[^>]*>)", "$1\u0001$2\u0001"), _BLOCK)
    texts = F.transform(blocks, lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, "<[^>]*>", " "), r"\s+", " ")))
    level = lambda b: F.regexp_extract(b, "^\u0001([1-6])\u0001", 1)
    lines = F.filter(F.transform(texts, lambda b: F.struct(F.trim(F.regexp_replace(b, "^\u0001[1-6]\u0001", "")).alias("text"), level(b).alias("h"))), lambda x: x["text"] != "")
    return pages.select(F.col("page_id").cast("string").alias("doc_id"), F.posexplode(lines).alias("line_no", "l")).select(
        "doc_id", "line_no", "l.text", F.lit(1).alias("page"), F.when(F.col("l.h") == "", 10.0).otherwise(24.0 - 2 * F.col("l.h").try_cast("int")).alias("size"), (F.col("l.h") != "").alias("bold"), F.lit(False).alias("in_margin")
    )
