"""Operator 11: how five filters interact, from one table of failure bits.

A: under 100 words; B: distinct words under 80 % of the words; C: over 10 % of the code points are A-Z; D: one of `#$%&*|`;
E: the text is also that of a smaller doc_id, anywhere in the table. A to D are bits of one scan. E is an existential
self-join: rows meet, by hash and exact text, the smallest doc_id of their text, and those with a larger one are marked. The marked
ids are added to the other failures, and the rows are counted by combination of bits. All 120 orders of the filters follow
from at most 32 combinations a part: no order is run.

Scale: texts whose hash stands once can't fail E. Two bitmaps of 2**FILTER_BITS hash values each (8 MB at 2**26, whatever the
input) say which hashes stand with several doc_ids, and which of them have HOT_ROWS rows or more; they go to all tasks, so only the texts of
copies (and, by chance, few others) are shuffled. Past some hundred million copied texts the bitmaps fill, and more texts travel; results stay the same. Hot
hashes are salted. The largest group that meets in a task is then 1/64 of the rows of one text, against a single row.

Null texts are empty, null languages the empty string. Repeated rows count each; rows with the same doc_id aren't smaller than
each other. A null doc_id is neither smaller nor larger than another: such rows never fail E and have no label. A doc_id
with several labels has the quality or toxicity that one of them has. Documents without a label are neither good nor toxic. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.llm._stage import HOT_ROWS, SALTS, drop_staged, staged

FILTERS = "ABCDE"
#: The bitmaps have 2**FILTER_BITS bits each.
FILTER_BITS = 26
_WORDS_OF = 1 << 15  # bits in a row of a bitmap
WORD = "[^\\x20\\x09-\\x0D]+"


def failure_bits(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for filters A to D of a text that isn't null."""
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")

    def bits(w: Column) -> Column:
        upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        return (
            F.when(F.size(w) < 100, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 80 * F.size(w), 2).otherwise(0)
            + F.when(100 * upper > 10 * F.length(text), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
        )

    return F.get(F.transform(F.array(words), bits), F.lit(0))  # the words are cut once


def _bit(bitmap: str) -> Column:
    """The bit of the row's place in a bitmap of _WORDS_OF bits."""
    return F.expr(f"shiftright(cast(conv(hex(substring({bitmap}, cast(shiftright(_place, 3) + 1 as int), 1)), 16, 10) as int), cast(_place % 8 as int)) & 1")


def copies(docs: DataFrame, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, h of the rows whose text is that of a smaller doc_id: the left-semi join on hash, exact text and smaller doc_id."""
    at = F.pmod("h", F.lit(1 << bits))
    shared = keys.filter("doc_id IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    maps = shared.select(at.alias("p"), "n").groupBy(F.shiftright("p", 15).alias("_row")).agg(
        F.expr(f"bitmap_construct_agg(p & {_WORDS_OF - 1})").alias("_copied"), F.expr(f"bitmap_construct_agg(p & {_WORDS_OF - 1}) FILTER (WHERE n >= {HOT_ROWS})").alias("_hot")
    )
    maps = staged(maps, "bitmaps")  # at most 2**(bits - 15) rows of 8 KB
    text = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    text = text.withColumn("_row", F.shiftright(at, 15)).withColumn("_place", at.bitwiseAND(F.lit(_WORDS_OF - 1)))
    near = text.join(F.broadcast(maps), "_row").filter(_bit("_copied") == 1).select("doc_id", "h", "text", (_bit("_hot") == 1).alias("_hot"))
    # a row for each text and task is shuffled, then one for each text is left
    first = near.groupBy("h", "text", "_hot").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    first = first.select("h", "text", "first", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))
    near = near.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    a, b = near.alias("a"), first.hint("merge").alias("b")
    return a.join(b, F.expr("a.h = b.h AND a._salt = b._salt AND a.text = b.text AND b.first < a.doc_id"), "left_semi").select("doc_id", "h")


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", bits: int = FILTER_BITS) -> DataFrame:
    """part, mask (bits of the filters failed), good, toxic, n: the documents by combination."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = staged(docs.select(F.col("doc_id"), F.xxhash64(text).alias("h"), F.coalesce(F.col(part), F.lit("")).alias("part"), failure_bits(text).alias("mask")), "failures")
    copied = staged(copies(docs, keys, bits), "copies")
    # equal rows become one with a count; E's ids are one more failure of their rows
    base = keys.groupBy("doc_id", "h", "part", "mask").agg(F.count("*").alias("n"))
    marked = base.filter("doc_id IS NOT NULL").join(copied.distinct().withColumn("_e", F.lit(16)), ["doc_id", "h"], "left")
    label = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = marked.select("doc_id", "part", F.col("mask").bitwiseOR(F.coalesce("_e", F.lit(0))).alias("mask"), "n").join(label, "doc_id", "left")
    no, every = F.lit(False), known.select("part", "mask", "good", "toxic", "n")
    every = every.unionByName(base.filter("doc_id IS NULL").select("part", "mask", no.alias("good"), no.alias("toxic"), "n"))
    return every.groupBy("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, filter_order and step, from the counts of combinations."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [{"o": "".join(p), "s": i + 1, "f": bit[f], "p": sum(bit[x] for x in p[:i])} for p in permutations(FILTERS) for i, f in enumerate(p)]
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,s:int,f:int,p:int>>")  # 600 rows, whatever the input
    at = counts.withColumn("_s", F.explode(table)).select("*", F.col("_s.o").alias("filter_order"), F.col("_s.s").alias("step"), F.col("_s.f").alias("_f"), F.col("_s.p").alias("_p"))
    fails, before = F.col("mask").bitwiseAND(F.col("_f")) != 0, F.col("mask").bitwiseAND(F.col("_p")) != 0
    removed = fails & ~before

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0))).cast("long").alias(name)

    found = at.groupBy("part", "filter_order", "step", "_f").agg(
        total(~fails & ~before, "kept"), total(removed, "removed"), total(fails & before, "redundant"), total(F.col("mask") == F.col("_f"), "unique_fails"),
        total(removed & F.col("good"), "good_lost"), total(removed & F.col("toxic"), "toxic_lost"),
    )
    shares = found.groupBy("part", "_f").agg(F.sum("removed").alias("shapley"))
    return found.join(shares, ["part", "_f"]).drop("_f")


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", bits: int = FILTER_BITS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit(staged(failure_counts(docs, labels, part, bits), "combinations"))
