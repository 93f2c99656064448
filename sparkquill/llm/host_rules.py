"""Operator 9: quality rules on documents, and verdicts on their hosts.

Each document gets counts over its whole text and the rule failures that follow from them. Failures are summed by host;
a host's failure rate is shrunk towards the rate of all hosts by a beta prior fitted to the hosts (method of moments),
so that a host with few documents isn't judged by them alone. A host whose shrunk rate is over `max_rate` is rejected
with all its documents.

Words are runs of anything but space and 0x09-0x0D. A null text has no words; a null host is a host of its own.
Windows of three words are compared by a 64-bit hash. An empty table gives no rows. Repeated rows count each.
Only DataFrame functions are used; the text is scanned once, and hosts join the documents' counts (not their texts)
with hot hosts salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.llm._stage import salted_lookup, staged

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: A host is rejected when more than this share of its documents fails, after shrinkage.
MAX_HOST_RATE = 0.75
NO_HOST = "\x00none"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside windows of three words that occur twice or more: sort the windows, keep those equal to a neighbour, and measure their union."""
    keyed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.cast("int").alias("i")),
    )
    return F.when(n >= 4, keyed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = docs.select(
        "doc_id",
        F.coalesce(F.col(host), F.lit(NO_HOST)).alias("host"),
        _words(text).alias("_w"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
    )
    base = base.withColumn("_n", F.size("_w"))
    base = base.withColumn("_s", F.sort_array(_repeat_words(F.col("_w"), F.col("_n"))))
    s = F.col("_s")
    base = base.withColumn(
        "_r",
        F.sort_array(
            F.transform(
                F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])),
                lambda x: x["i"],
            )
        ),
    )
    r = F.col("_r")
    covered = F.aggregate(
        F.transform(r, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(r, k + 1) - x, F.lit(3)))), F.lit(0), lambda acc, v: acc + v
    )
    return base.select(
        "doc_id",
        "host",
        F.col("_n").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rule_failed() -> Column:
    """The rules that count against a host: the base rules, symbols in over a tenth of the characters, odd word lengths, over half of the words' lines repeated."""
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return F.col("base_failed") | (10 * F.col("n_symbols") > F.col("word_chars")) | (mean < 2) | (mean > 20) | (F.col("n_dup_lines") * 10 > F.col("n_words"))


def host_verdicts(counted: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_rejected."""
    hosts = counted.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if(rule_failed()).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.coalesce(F.avg(rate), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"))
    # beta prior by moments; strength between 1 and 1000, so that equal rates (no variance) stay finite
    strength = F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(1000.0))))
    return (
        hosts.crossJoin(F.broadcast(prior.select("m", strength.alias("strength"))))
        .withColumn("shrunk_rate", (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength")))
        .select("host", "n_docs", "n_failed", "shrunk_rate", (F.col("shrunk_rate") > max_rate).alias("host_rejected"))
    )


def host_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Counts, base_failed, the host's shrunk rate and kept for every document."""
    counted = staged(document_rules(docs, host), "rules")
    verdicts = staged(host_verdicts(counted, max_rate), "hosts")
    return (
        salted_lookup(counted, verdicts, "host", "doc_id", "n_docs")
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))
        .drop("n_docs", "n_failed", "host_rejected")
    )
