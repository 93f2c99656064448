"""Verification of quoted citations and of recorded model replies."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.functions import text as T
from sparkquill.operators import ranks

# ---- fixed values: the messages of a refusal ----

UNVERIFIED = "The model drafted an answer but none of its citations could be verified against the retrieved passages, so it was withheld."
CUT_OFF = "The model's reply was cut off at the token limit, so no answer was produced."
UNSUPPORTED = "The retrieved passages do not support an answer."


def parse_citations(generations: DataFrame) -> DataFrame:
    """qid, payload (JSON text) -> qid, pos, source (int or null), quote (string or null), shown: one row for each citation of a list.

    Types are strict: a source that is a boolean, a fraction or text, and a quote that isn't text, are null. Anything but a list has no citations.
    """
    listed = generations.select("qid", F.try_parse_json("payload").alias("v")).select("qid", F.try_variant_get("v", "$.citations", "variant").alias("c"))
    items = listed.filter(F.schema_of_variant("c").startswith("ARRAY")).select("qid", F.posexplode(F.col("c").cast("array<variant>")).alias("pos", "item"))
    kind = lambda field: F.schema_of_variant(F.try_variant_get("item", f"$.{field}", "variant"))
    quote = F.when(kind("quote") == "STRING", F.try_variant_get("item", "$.quote", "string"))
    source = F.when(kind("source") == "BIGINT", F.try_variant_get("item", "$.source", "long"))
    return items.select("qid", "pos", source.alias("source"), quote.alias("quote"), F.left(F.coalesce(quote, F.to_json("item")), F.lit(200)).alias("shown"))


def check_citations(citations: DataFrame, retrieved: DataFrame, math: bool = True) -> DataFrame:
    """qid, pos, source, quote, shown and the retrieved chunks (qid, rank, chunk_id, paper_id, section, page, text) -> every citation with `verdict`.

    kept: the source is a rank of the question and the quote stands in that chunk; merged: a kept (source, quote) came
    before; dropped: anything else.
    """
    spelled = T.squash_math if math else T.squash
    pieces = citations.select("qid", "pos", F.posexplode(T.fragments(F.col("quote"))).alias("n", "piece")).select("qid", "pos", "n", spelled(F.col("piece")).alias("piece"))
    parts = pieces.groupBy("qid", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda s: s["piece"]).alias("_parts"))
    held = retrieved.select("qid", F.col("rank").cast("long").alias("source"), "chunk_id", "paper_id", "section", "page", spelled(F.col("text")).alias("_hay"))
    met = citations.join(parts, ["qid", "pos"], "left").join(held, ["qid", "source"], "left")
    good = F.coalesce(F.col("quote").isNotNull() & F.col("chunk_id").isNotNull() & T.ordered_containment(F.col("_parts"), F.col("_hay")), F.lit(False))
    judged = met.withColumn("_good", good).withColumn("_key", T.squash(F.col("quote")))
    first = F.row_number().over(Window.partitionBy("qid", "_good", "source", "_key").orderBy("pos"))
    return judged.withColumn("verdict", F.when(~F.col("_good"), F.lit("dropped")).when(first == 1, F.lit("kept")).otherwise(F.lit("merged"))).drop("_good", "_key", "_parts", "_hay")


def build_responses(generations: DataFrame, checked: DataFrame, retrieved: DataFrame, price_in: float = 0.0, price_out: float = 0.0) -> DataFrame:
    """One response for each generation (qid, payload, input_tokens, output_tokens, truncated): answered only with a yes, an answer and a kept citation."""
    citation = F.struct("pos", "paper_id", "section", "page", "chunk_id", F.trim("quote").alias("quote"))
    by_q = checked.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.col("verdict") == "kept", citation))).alias("citations"),
        F.count_if(F.col("verdict") == "dropped").alias("dropped_citations"),
        F.array_sort(F.collect_list(F.when(F.col("verdict") == "dropped", F.struct("pos", "shown")))).alias("_dropped"),
    )
    ids = retrieved.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]).alias("retrieved_chunk_ids"))
    g = generations.withColumn("_v", F.try_parse_json("payload")).join(by_q, "qid", "left").join(ids, "qid", "left")
    text = lambda f: F.when(F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant")) == "STRING", F.trim(F.try_variant_get("_v", f"$.{f}", "string")))
    can = F.coalesce((F.schema_of_variant(F.try_variant_get("_v", "$.can_answer", "variant")) == "BOOLEAN") & F.try_variant_get("_v", "$.can_answer", "boolean"), F.lit(False))
    empty = F.coalesce(F.col("payload").isin("{}", ""), F.lit(True))
    none = F.coalesce(F.size("retrieved_chunk_ids"), F.lit(0)) <= 0
    g = g.withColumn("_can", can).withColumn("_answer", F.coalesce(text("answer"), F.lit(""))).withColumn("_reason", F.nullif(F.coalesce(text("refusal_reason"), F.lit("")), F.lit("")))
    answered = F.col("_can") & (F.col("_answer") != "") & (F.coalesce(F.size("citations"), F.lit(0)) > 0) & ~none
    reason = F.when(none, F.lit(UNSUPPORTED)).when(F.col("_can"), F.lit(UNVERIFIED)).when(F.col("truncated") & empty, F.lit(CUT_OFF)).otherwise(F.coalesce("_reason", F.lit(UNSUPPORTED)))
    return g.select(
        "qid", F.when(answered, F.lit("answered")).otherwise(F.lit("refused")).alias("status"), F.when(answered, F.col("_answer")).alias("answer"),
        F.when(answered, F.transform("citations", lambda c: c.dropFields("pos"))).otherwise(F.array()).alias("citations"),
        F.when(~answered, reason).alias("refusal_reason"), "input_tokens", "output_tokens",
        T.cost_usd(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out).alias("estimated_cost_usd"),
        "retrieved_chunk_ids", F.coalesce("dropped_citations", F.lit(0)).alias("dropped_citations"), F.transform("_dropped", lambda d: d["shown"]).alias("dropped_quotes"),
    )


def faithfulness(claims: DataFrame) -> DataFrame:
    """qid, claims (array of struct with supported) -> qid, faithfulness: supported claims over claims, null without any."""
    return claims.select("qid", F.try_divide(F.size(F.filter("claims", lambda c: F.coalesce(c["supported"], F.lit(False)))), F.size(F.filter("claims", lambda c: c.isNotNull()))).alias("faithfulness"))


def render_sources(retrieved: DataFrame, titles: DataFrame) -> DataFrame:
    """qid, message: the retrieved passages numbered by rank."""
    named = retrieved.join(titles.select("paper_id", "title"), "paper_id", "left")
    line = F.format_string("[%d] %s, %s, page %d\n%s\n", F.col("rank").cast("int"), F.coalesce("title", "paper_id"), "section", "page", "text")
    return named.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n").alias("message"))


def spot_check(results: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows picked by the md5 of seed and qid: the same picks for the same seed."""
    return results.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("qid").cast("string")).cast("binary")), "qid").limit(n)


def spot_check_passages(results: DataFrame, chunks: DataFrame, n: int, seed: int = 0, order: str = "qid") -> DataFrame:
    """n of the judged answers for a person to mark, with the passages they cite in the order cited: the picks of Python's `random.Random(seed).sample`.

    results: qid, answer, cited_chunk_ids, faithfulness, claims and `order`, which tells the rows apart. Answers that are null or empty, and those without claims, aren't
    picked. The generator draws row numbers (the driver holds these n alone); `pick` is their order. Cited chunks that aren't in `chunks` are left out.
    """
    judged = results.filter((F.size("claims") > 0) & (F.col("answer") != ""))
    placed = ranks.numbered(judged, [order], "_row")
    total = judged.count()
    drawn = random.Random(seed).sample(range(total), min(n, total))
    picks = results.sparkSession.createDataFrame(list(enumerate(drawn)), "pick int, _row long")
    picked = placed.join(F.broadcast(picks), "_row").drop("_row")  # n rows, asked for by the caller
    cited = picked.select("pick", F.posexplode("cited_chunk_ids").alias("pos", "chunk_id"))
    found = cited.join(chunks.select("chunk_id", "text"), "chunk_id").groupBy("pick").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "text"))).alias("_p"))
    passages = F.transform(F.coalesce("_p", F.array().cast(found.schema["_p"].dataType)), lambda p: F.struct(p["chunk_id"].alias("chunk_id"), p["text"].alias("text")))
    return picked.join(found, "pick", "left").withColumn("cited_passages", passages).withColumn("human_supported", F.lit(None).cast("boolean")).drop("_p")


def answer_results(gold: DataFrame, responses: DataFrame, resolved: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """One row for each gold question with what `metrics.summarize_answers` reads.

    gold: qid, kind, evidence. responses: qid, status, citations, dropped_citations, latency_ms, input_tokens,
    output_tokens, estimated_cost_usd, error. resolved: qid, chunk_id. judged: qid, faithfulness, judge_cost_usd, judge_error.
    Citation scores exist only for answered, answerable questions; a question without a response counts as a failed one.
    """
    ids = resolved.groupBy("qid").agg(F.collect_set("chunk_id").alias("_gold"))
    j = gold.join(responses, "qid", "left").join(ids, "qid", "left")
    columns = {"faithfulness": "double", "judge_cost_usd": "double", "judge_error": "string"}
    j = j.join(judged.select("qid", *columns), "qid", "left") if judged is not None else j.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})
    should, refused = F.col("kind") == "unanswerable", F.coalesce(F.col("status") == "refused", F.lit(False))
    failed = F.when(F.col("status").isNull(), F.coalesce("error", F.lit("no response"))).otherwise(F.col("error"))
    cited, known = F.coalesce("citations", F.array().cast(responses.schema["citations"].dataType)), F.coalesce("_gold", F.array().cast("array<string>"))
    scored = failed.isNull() & ~refused & ~should
    pages = F.transform("evidence", lambda e: F.struct(e["paper_id"].alias("paper_id"), e["page"].alias("page")))
    papers = F.transform("evidence", lambda e: e["paper_id"])

    def share(flag) -> Column:
        return F.try_divide(F.size(F.filter(cited, flag)), F.size(cited))

    return j.select(
        "qid", "kind", should.alias("should_refuse"), refused.alias("refused"),
        F.when(scored, F.coalesce(share(lambda c: F.array_contains(known, c["chunk_id"])), F.lit(0.0))).alias("citation_precision"),
        F.when(scored, share(lambda c: F.array_contains(pages, F.struct(c["paper_id"].alias("paper_id"), c["page"].alias("page"))))).alias("citation_precision_page"),
        F.when(scored, F.exists(cited, lambda c: F.array_contains(known, c["chunk_id"]))).alias("citation_hit"),
        F.when(scored, F.exists(cited, lambda c: ~F.array_contains(papers, c["paper_id"]))).alias("wrong_paper_citation"),
        F.when(failed.isNull() & ~refused, F.col("faithfulness")).alias("faithfulness"), F.coalesce("judge_cost_usd", F.lit(0.0)).alias("judge_cost_usd"),
        F.coalesce("dropped_citations", F.lit(0)).alias("dropped_citations"), F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"),
        F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), F.coalesce("estimated_cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce(failed, F.when(F.col("judge_error").isNotNull(), F.concat(F.lit("judge failed: "), "judge_error"))).alias("error"),
    )


def summary_table(summary: DataFrame) -> DataFrame:
    """The summary row as (metric, value) rows of text, in the order of its columns."""
    cells = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(c).alias("metric"), (T.fmt(F.col(c)) if kind == "double" else F.coalesce(F.col(c).cast("string"), F.lit("–"))).alias("value")) for i, (c, kind) in enumerate(summary.dtypes)])
    return summary.select(F.explode(cells).alias("c")).select("c.n", "c.metric", "c.value")
