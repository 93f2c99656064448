"""Resolving quotes to the chunks and pages that contain them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.functions import text as T
from sparkquill.operators.anchors import anchored, level_of
from sparkquill.staging import staged

#: Keys up to so many are sent to all tasks.
SENT = 250_000


def squashed(df: DataFrame, text: str = "text", compatibility: bool = True) -> DataFrame:
    return df.withColumn("squashed", T.squash(F.col(text), compatibility))


def _levels(asked: DataFrame) -> list[int]:
    """The levels that occur: six at most."""
    return sorted(r["level"] for r in asked.select("level").distinct().filter("level IS NOT NULL").toLocalIterator())


def _near(asked: DataFrame, pieces: DataFrame, held: DataFrame, group: str, place: str) -> DataFrame:
    """Candidates: the columns of `asked` and `place`, for the texts t of `held` that share group and anchor with a piece (level, piece) of `asked`.

    Joined by (group, anchor), so that a group with many texts is as many keys as it has anchors. A text has anchors at the levels alone that its own group asks for:
    short pieces, whose levels have an anchor for almost every character, cost what their groups hold.
    """
    levels = _levels(asked)
    wanted = anchored(pieces, "piece", levels, "level").drop("level")
    by_group = staged(asked.filter("level IS NOT NULL").select(group, "level").distinct(), "levels")
    by_group = by_group.hint("broadcast" if by_group.count() <= SENT else "merge")
    runs = anchored(held.select(group, place, "t").join(by_group, group), "t", levels, "level").drop("level")
    return runs.hint("merge").join(wanted.hint("merge"), [group, "anchor"]).select(*[c for c in asked.columns if c != "level"], place).distinct()


def _asked(evidence: DataFrame, group: str, compatibility: bool = True) -> DataFrame:
    q = evidence.filter("quote IS NOT NULL").select("qid", "ev", F.col("paper_id").alias(group), T.squash(F.col("quote"), compatibility).alias("q"))
    return staged(q.distinct().withColumn("level", level_of(F.col("q"))), "quotes")


def resolve(evidence: DataFrame, chunks: DataFrame, compatibility: bool = True) -> DataFrame:
    """qid, ev, paper_id, quote of evidence -> qid, ev, chunk_id, whole.

    Chunks of the same paper that contain the whole squashed quote; only where there is none, those with its first or last
    MIN_PIECE characters. Candidates share the anchor of one of these pieces (`anchors`); the texts of those alone are read for the rest. A quote that
    squashes to nothing is contained in every chunk of its paper; a null one in none. Evidence that is repeated counts once.
    """
    asked = _asked(evidence, "paper_id", compatibility)
    held = staged(chunks.join(asked.select("paper_id").distinct(), "paper_id", "left_semi").select("paper_id", "chunk_id", T.squash(F.col("text"), compatibility).alias("t")), "squashed")
    # a text with the whole quote has its head; a quote under MIN_PIECE is its own head and tail
    ends = F.array_distinct(F.array(F.left("q", F.col("level")), F.when(F.col("level") == T.MIN_PIECE, F.right("q", F.col("level"))).otherwise(F.left("q", F.col("level")))))
    near = _near(asked, asked.filter("level IS NOT NULL").select("qid", "ev", "paper_id", "q", "level", F.explode(ends).alias("piece")), held, "paper_id", "chunk_id")
    head, tail = F.left("q", F.lit(T.MIN_PIECE)), F.right("q", F.lit(T.MIN_PIECE))
    met = near.join(held.hint("merge"), ["paper_id", "chunk_id"]).select(
        "qid", "ev", "chunk_id", F.contains("t", "q").alias("whole"), (F.contains("t", head) | F.contains("t", tail)).alias("piece")
    ).filter(F.col("whole") | F.col("piece"))
    every = asked.filter("q = ''").join(held.filter("t IS NOT NULL").hint("merge"), "paper_id").select("qid", "ev", "chunk_id", F.lit(True).alias("whole"), F.lit(True).alias("piece"))  # the output itself
    best = met.unionByName(every).withColumn("any_whole", F.max("whole").over(Window.partitionBy("qid", "ev")))
    return best.filter(F.col("whole") | ~F.col("any_whole")).select("qid", "ev", "chunk_id", "whole")


def resolve_anywhere(quotes: DataFrame, chunks: DataFrame, compatibility: bool = True) -> DataFrame:
    """qid, ev, quote -> qid, ev, chunk_id for quotes without a known paper.

    A chunk with the quote has all of the quote's anchors; the rarest of them among all chunks picks the candidates, so that a quote which begins
    with a phrase of many chunks doesn't meet them all. The anchors alone are joined; texts come back for the chunks that met. A quote that
    squashes to nothing is contained in every chunk; a null one in none.
    """
    asked = staged(quotes.filter("quote IS NOT NULL").select("qid", "ev", T.squash(F.col("quote"), compatibility).alias("q")).withColumn("level", level_of(F.col("q"))), "quotes")
    levels = _levels(asked)
    held = staged(chunks.select("chunk_id", T.squash(F.col("text"), compatibility).alias("t")), "squashed").filter("t IS NOT NULL")  # only now: a filter before would squash twice, over rows with all words of a document
    wanted = staged(anchored(asked.filter("level IS NOT NULL").withColumn("piece", F.col("q")), "piece", levels, "level").drop("level"), "wanted")
    hits = staged(anchored(held, "t", levels).join(wanted.select("anchor").distinct(), "anchor", "left_semi"), "hits")
    common = hits.groupBy("anchor").agg(F.count("*").alias("n"))
    # a quote with an anchor that no chunk has is in no chunk: the left join makes it the rarest
    rarest = wanted.join(common, "anchor", "left").groupBy("qid", "ev", "q").agg(F.min_by("anchor", F.struct(F.coalesce("n", F.lit(0)), "anchor")).alias("anchor"))
    near = hits.join(rarest, "anchor").select("qid", "ev", "q", "chunk_id").distinct()
    met = near.join(held.hint("merge"), "chunk_id").filter(F.contains("t", "q")).select("qid", "ev", "chunk_id")
    every = held.select("chunk_id").crossJoin(asked.filter("q = ''").select("qid", "ev"))  # the output itself
    return met.unionByName(every.select("qid", "ev", "chunk_id")).distinct()


def with_papers(rankings: DataFrame, chunks: DataFrame) -> DataFrame:
    """`rankings` with the paper_id of each chunk_id; a chunk that isn't in the corpus is an error."""
    known = chunks.groupBy("chunk_id").agg(F.min("paper_id").alias("paper_id")).hint("merge")
    absent = F.raise_error(F.concat(F.lit("no such chunk: "), F.col("chunk_id").cast("string"))).cast("string")
    return rankings.join(known, "chunk_id", "left").withColumn("paper_id", F.coalesce("paper_id", absent))


def gold_chunks(resolved: DataFrame) -> DataFrame:
    return resolved.select("qid", "chunk_id").distinct()


def unresolved(evidence: DataFrame, chunks: DataFrame, resolved: DataFrame) -> DataFrame:
    """qid, ev, problem: papers that aren't in the corpus, and quotes that aren't in their paper."""
    papers = staged(chunks.select("paper_id").join(evidence.select("paper_id").distinct(), "paper_id", "left_semi").distinct(), "papers")
    missing = evidence.join(papers, "paper_id", "left_anti").select("qid", "ev", F.concat(F.lit("paper '"), "paper_id", F.lit("' is not in the corpus")).alias("problem"))
    known = evidence.join(papers, "paper_id", "left_semi").join(resolved.select("qid", "ev").distinct(), ["qid", "ev"], "left_anti")
    return missing.unionByName(known.select("qid", "ev", F.concat(F.lit("quote not found in "), "paper_id").alias("problem")))


def quote_pages(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """qid, ev, found_pages: pages with the whole quote, else the page where it starts if it runs over to the next. Papers without pages have no row.

    Either page has the quote's first characters: their anchor finds the candidates, by paper and anchor.
    """
    asked = _asked(evidence, "doc_id")
    text = pages.join(asked.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "page", T.squash(F.col("text")).alias("t"))
    text = staged(text.withColumn("next", F.lead("t").over(Window.partitionBy("doc_id").orderBy("page"))), "squashed")
    near = _near(asked, asked.filter("level IS NOT NULL").select("qid", "ev", "doc_id", "q", "level", F.left("q", F.col("level")).alias("piece")), text, "doc_id", "page")
    met = near.join(text.hint("merge"), ["doc_id", "page"]).select(
        "qid", "ev", "page", F.contains("t", "q").alias("whole"),
        (F.contains(F.concat("t", F.coalesce("next", F.lit(""))), F.col("q")) & F.contains("t", F.left("q", F.lit(T.MIN_PIECE))) & F.col("next").isNotNull()).alias("starts"),
    )
    every = asked.filter("q = ''").join(text.filter("t IS NOT NULL").hint("merge"), "doc_id").select("qid", "ev", "page", F.lit(True).alias("whole"), F.lit(False).alias("starts"))
    none = asked.join(text.select("doc_id").distinct(), "doc_id", "left_semi").select("qid", "ev", F.lit(None).cast("int").alias("page"), F.lit(False).alias("whole"), F.lit(False).alias("starts"))
    grouped = met.unionByName(every).unionByName(none).groupBy("qid", "ev").agg(
        F.array_sort(F.collect_list(F.when(F.col("whole"), F.col("page")))).alias("w"), F.min(F.when(F.col("starts"), F.col("page"))).alias("s")
    )
    return grouped.select("qid", "ev", F.when(F.size("w") > 0, F.col("w")).when(F.col("s").isNotNull(), F.array("s")).otherwise(F.array().cast("array<int>")).alias("found_pages"))


def fix_pages(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Evidence with its page set to the first page found, and a note of what changed. Papers without pages are left alone."""
    found = quote_pages(evidence, pages)
    joined = evidence.join(found, ["qid", "ev"], "left")
    some, listed = F.size("found_pages") > 0, F.array_contains("found_pages", F.col("page"))
    note = (
        F.when(F.col("found_pages").isNull(), F.lit(None).cast("string"))
        .when(~some, F.format_string("%s: quote not found in %s (left page %d)", "qid", "paper_id", "page"))
        .when(~listed, F.format_string("%s: %s page %d -> %d", "qid", "paper_id", "page", F.get("found_pages", F.lit(0))))
    )
    page = F.when(some & ~listed, F.get("found_pages", F.lit(0))).otherwise(F.col("page"))
    return joined.withColumn("note", note).withColumn("page", page).drop("found_pages")
