"""Gapless row numbers and nearest-rank percentiles over whole tables, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.staging import staged

_PLACE = (1 << 33) - 1


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` in ranges of the order, with _part, the number of its range, and _i, the row's number in it; staged, so that both stay."""
    placed = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "in_order")
    return placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND(F.lit(_PLACE))).drop("_at")


def numbered(df: DataFrame, order: list[str], out: str = "i") -> DataFrame:
    """`df` with row numbers from 0 in the given order, which should tell all rows apart."""
    placed = in_order(df, order)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each range
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")


def nearest_ranks(df: DataFrame, groups: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """groups, and for each name in `percents` the smallest value with at least that percentage of the group's values at or below it.

    Equal values are counted first; the counts are dealt in ranges of (group, value), so a group with a third of all rows is
    dealt to many tasks. Nulls aren't counted; a group with nulls alone has no row. Without groups: one row, with nulls for an empty table.
    """
    key = F.struct(*[F.col(f"`{g}`") for g in groups], F.lit(0).alias("_")).alias("_g")
    counts = df.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("_v")).groupBy("_g", "_v").agg(F.count("*").alias("_c"))
    placed = in_order(counts, ["_g", "_v"])
    parts = placed.groupBy("_g", "_part").agg(F.sum("_c").alias("_p"))  # a row for each range, and one more for each group that begins in it
    order = Window.partitionBy("_g").orderBy("_part")
    before = parts.select("_g", "_part", F.coalesce(F.sum("_p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_p").over(Window.partitionBy("_g")).alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy("_g", "_part").orderBy("_v")) + F.col("_before")
    ranked = placed.join(before, ["_g", "_part"]).withColumn("_upto", upto)

    def at(percent: float) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(F.lit(percent) * F.col("_n") / 100))
        return F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank), F.col("_v")))

    values = [at(p).alias(name) for name, p in percents.items()]
    return ranked.groupBy("_g").agg(*values).select(*[F.col(f"_g.`{g}`").alias(g) for g in groups], *percents) if groups else ranked.agg(*values)
