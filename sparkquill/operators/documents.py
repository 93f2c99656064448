"""From lines of paged documents to titled sections and page-aware word windows.

Lines: doc_id, line_no, text, page, size, bold, in_margin. Everything is keyed by doc_id; a document's lines meet in
windows over their line numbers, and only its headings (few) are gathered into one row for the order of sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.functions import text as T
from sparkquill.operators.chunking import OVERLAP, SIZE, window_starts
from sparkquill.staging import staged

DEFAULT_SIZE = 10.0


def drop_running_lines(lines: DataFrame) -> DataFrame:
    """Margin lines whose text (numbers masked) stands on max(2, pages div 2) pages or more go, and bare page numbers in the margin."""
    key = T.line_key(F.col("text"))
    pages = lines.groupBy("doc_id").agg(F.max("page").alias("_pages"))
    seen = lines.filter("in_margin").groupBy("doc_id", key.alias("_key")).agg(F.countDistinct("page").alias("_n"))
    running = seen.join(pages, "doc_id").filter(F.col("_n") >= F.greatest(F.lit(2), F.expr("_pages div 2"))).select("doc_id", "_key")
    body, margin = lines.filter(~F.col("in_margin")), lines.filter("in_margin").withColumn("_key", key)
    kept = margin.join(running, ["doc_id", "_key"], "left_anti").filter(~F.col("text").rlike(r"^\d{1,3}$")).select(lines.columns)
    return body.unionByName(kept)


def body_sizes(lines: DataFrame) -> DataFrame:
    """doc_id, body: the font size (1 decimal) of most text; the first seen of equal ones."""
    sized = lines.groupBy("doc_id", F.round("size", 1).alias("s")).agg(F.sum(F.length("text")).alias("n"), F.min("line_no").alias("first"))
    return sized.groupBy("doc_id").agg(F.max_by("s", F.struct("n", -F.col("first"))).alias("body"))


def is_heading(text: Column, size: Column, bold: Column, body: Column, long_numbers: bool = False) -> Column:
    text = F.trim(text)
    pattern = T.LONG_HEADING_NUMBERED if long_numbers else T.HEADING_NUMBERED
    numbered = text.rlike(pattern)
    rest = F.regexp_extract(text, pattern, 2)
    named = text.rlike(T.HEADING_NAMED)
    return (
        F.when((F.size(F.split(text, r"\s+")) > 12) | (F.length(text) < 3) | (size < body - 0.5), False)
        .when(text.rlike(T.HEADING_ROMAN), True)
        .when(text.rlike("[,;]$"), False)
        .when(numbered & T.all_caps(rest), True)
        .when(named & T.all_caps(text), True)
        .when(bold | (size >= body + 0.8), numbered | named)
        .otherwise(False)
    )


def merge_split_headings(lines: DataFrame, long_numbers: bool = False) -> DataFrame:
    """A section number alone on its line joins the title on the next line of the page (1 to 12 words, upper-case start); the pair is bold or large if either half is.

    Pairs are taken greedily from the top: in a run of lines that could each start a pair, the odd ones do.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    follow = F.lead(F.struct("text", "page", "size", "bold")).over(order)
    n_words = F.size(F.split(F.trim(follow["text"]), r"\s+"))
    fits = F.trim("text").rlike(T.LONG_NUMBER_ONLY if long_numbers else T.NUMBER_ONLY) & (F.col("size") >= F.col("body") - 0.5) & (follow["page"] == F.col("page")) & follow["text"].rlike(r"^\p{Lu}") & n_words.between(1, 12)
    marked = lines.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_next", follow)
    marked = marked.withColumn("_breaks", F.sum(F.when(F.col("_fits"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = F.row_number().over(Window.partitionBy("doc_id", "_breaks", "_fits").orderBy("line_no"))
    marked = marked.withColumn("_pairs", F.col("_fits") & (in_run % 2 == 1))
    taken = F.coalesce(F.lag("_pairs").over(order), F.lit(False))
    joined = (
        marked.withColumn("_taken", taken)
        .withColumn("text", F.when(F.col("_pairs"), F.concat(F.trim("text"), F.lit(" "), F.trim("_next.text"))).otherwise(F.col("text")))
        .withColumn("size", F.when(F.col("_pairs"), F.greatest("size", "_next.size")).otherwise(F.col("size")))
        .withColumn("bold", F.col("bold") | (F.col("_pairs") & F.col("_next.bold")))
    )
    return joined.filter(~F.col("_taken")).select(lines.columns)


def _accept(state: Column, title: Column, long_numbers: bool = False) -> Column:
    """One step over a document's heading candidates: numbers advance by at most two, never back, and not before the body begins."""
    pattern = T.LONG_HEADING_NUMBERED if long_numbers else T.HEADING_NUMBERED
    numbered = title.rlike(pattern)
    number = F.regexp_extract(title, pattern, 1)
    rest = F.regexp_extract(title, pattern, 2)
    top = F.substring_index(number, ".", 1)
    opening = title.rlike(T.HEADING_NAMED) | title.rlike(T.HEADING_ROMAN)
    intro = rest.rlike(T.INTRO_LIKE)
    begins = state["started"] | ((top == "1") & intro & ~rest.rlike(T.AFFILIATION))
    digits = top.rlike(r"^\d+$")
    n = F.coalesce(top.try_cast("int"), F.lit(0))
    number_ok = ((n == 1) & intro) | n.between(state["num"], state["num"] + 2)
    letter_ok = (state["letter"] == "") | (F.ascii(top) - F.ascii(state["letter"])).between(0, 2)
    ok = F.when(~numbered, True).when(~begins, False).when(digits, number_ok).otherwise(letter_ok)
    return F.struct(
        F.when(numbered & ok & digits, n).otherwise(state["num"]).alias("num"),
        F.when(numbered & ok & ~digits, top).otherwise(state["letter"]).alias("letter"),
        F.when(numbered, begins).otherwise(state["started"] | opening).alias("started"),
        F.concat(state["ok"], F.array(ok)).alias("ok"),
    )


def headings(lines: DataFrame, long_numbers: bool = False) -> DataFrame:
    """doc_id, line_no, title of the lines that start a section, in the order the numbering allows."""
    found = lines.filter(is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body"), long_numbers)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.trim("text").alias("title")))).alias("h"))
    start = F.struct(F.lit(0).alias("num"), F.lit("").alias("letter"), F.lit(False).alias("started"), F.array().cast("array<boolean>").alias("ok"))
    judged = found.withColumn("ok", F.aggregate("h", start, lambda s, x: _accept(s, x["title"], long_numbers))["ok"])
    return judged.select("doc_id", F.explode(F.arrays_zip("h", "ok")).alias("z")).filter("z.ok").select("doc_id", "z.h.line_no", T.clean_title(F.col("z.h.title")).alias("title"))


def split_sections(lines: DataFrame, body: float | None = None, long_numbers: bool = False) -> DataFrame:
    """Lines with section_no (of non-empty sections, from 0) and section title; reference lists are left out until an appendix begins.

    Where the body's font size is known, `body` gives it; else it is that of most text. Sections are numbered up to 19, with `long_numbers` without end.
    """
    if body is None:
        with_body = lines.join(body_sizes(lines), "doc_id", "left").withColumn("body", F.coalesce("body", F.lit(DEFAULT_SIZE)))
    else:
        with_body = lines.withColumn("body", F.lit(body))
    merged = staged(merge_split_headings(with_body, long_numbers), "lines")  # read twice: its windows run once
    marked = merged.join(headings(merged, long_numbers), ["doc_id", "line_no"], "left")
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.coalesce(F.col("title").rlike(T.STOP_SECTIONS), F.lit(False))
    appendix = F.coalesce(F.col("title").rlike(T.APPENDIX_START), F.lit(False)) & ~stop
    skip = F.coalesce(F.last(F.when(stop, True).when(appendix, False), ignorenulls=True).over(order), F.lit(False))
    flagged = marked.withColumn("_skip", skip).filter(~F.col("_skip"))
    starts = F.count("title").over(order)
    titled = flagged.withColumn("_s", starts).withColumn("section", F.coalesce(F.last("title", ignorenulls=True).over(order), F.lit("Front matter"))).filter("title IS NULL")
    return titled.withColumn("section_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_s")) - 1).drop("_s", "_skip", "title", "body")


def section_words(sections: DataFrame) -> DataFrame:
    """doc_id, section_no, section, pos, word, page; a word cut by a hyphen at a line's end is joined if the next line goes on in lower case, and keeps the page of its first half."""
    parts = sections.select("doc_id", "section_no", "section", "line_no", "page", F.filter(F.split(T.normalize(F.col("text")), " "), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    order = Window.partitionBy("doc_id", "section_no").orderBy("line_no")
    last = F.element_at("w", -1)
    opens = F.endswith(last, F.lit("-")) & (F.length(last) > 1)
    goes_on = F.coalesce(F.get("w", F.lit(0)).rlike(r"^\p{Ll}") & F.lag(opens).over(order), F.lit(False))
    parts = parts.withColumn("_joins", goes_on)
    words = parts.select("*", F.posexplode("w").alias("_i", "word"))
    place = Window.partitionBy("doc_id", "section_no").orderBy("line_no", "_i")
    # each word that isn't the second half of another begins a group
    grouped = words.withColumn("_g", F.sum(F.when(F.col("_joins") & (F.col("_i") == 0), 0).otherwise(1)).over(place))
    joined = grouped.groupBy("doc_id", "section_no", "section", "_g").agg(F.array_sort(F.collect_list(F.struct("line_no", "_i", "word", "page"))).alias("p"))
    glued = F.aggregate("p", F.lit(""), lambda acc, x: F.concat(F.when(acc == "", F.lit("")).otherwise(F.left(acc, F.length(acc) - 1)), x["word"]))
    return joined.select("doc_id", "section_no", "section", (F.col("_g") - 1).alias("pos"), glued.alias("word"), F.get("p", F.lit(0))["page"].alias("page"))


def chunk_sections(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, paper_id, section, page, text: windows of a section's words; a window has the page of its first word."""
    words = section_words(sections).groupBy("doc_id", "section_no", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "page"))).alias("w"))
    each = words.select("*", F.posexplode(window_starts(F.size("w"), size, overlap)).alias("n", "_start"))
    piece = F.slice("w", F.col("_start") + 1, size)
    name = F.format_string("%s:%02d-%s:%03d", F.col("doc_id").cast("string"), F.col("section_no").cast("int"), T.slug(F.col("section")), F.col("n"))
    return each.select(name.alias("chunk_id"), F.col("doc_id").cast("string").alias("paper_id"), "section", F.get(piece, F.lit(0))["page"].alias("page"), F.array_join(F.transform(piece, lambda x: x["word"]), " ").alias("text"))


def ingest(lines: DataFrame, size: int = SIZE, overlap: int = OVERLAP, body: float | None = None, long_numbers: bool = False) -> DataFrame:
    return chunk_sections(split_sections(drop_running_lines(lines), body, long_numbers), size, overlap)


def ingest_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("paper_id").agg(F.countDistinct("section").alias("sections"), F.count("*").alias("chunks"))
