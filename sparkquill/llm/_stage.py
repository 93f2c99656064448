"""Joins that stand a hot key, and splits that stay; durable tables come from `sparkquill.staging`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.staging import drop_path, drop_staged, new_path, shared_dir, staged

__all__ = ["drop_path", "drop_staged", "new_path", "pin_splits", "salted_lookup", "shared_dir", "staged"]

#: A key with at least this many rows is joined through salted copies.
HOT_ROWS = 128
SALTS = 64


def pin_splits(spark: SparkSession) -> None:
    """Fixes the number of cores that Spark plans file splits for at today's (unless it is fixed already), so that two scans of
    one input have the same splits although executors come or go in between."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(int(spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)))


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, spread: str, count: str, nulls: bool = False) -> DataFrame:
    """Left join of `rows` with `table` (unique in `key`, with the number of rows of that key in `count`).

    Keys with HOT_ROWS rows or more are copied to SALTS salts, so that their rows meet them in as many tasks;
    `spread` is a column of `rows` whose hash picks the salt. The other keys join plainly. With `nulls`, rows without a
    key, which may be many, take no part in the joins.
    """
    hot = table.filter(F.col(count) >= HOT_ROWS).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_hot", F.lit(True))
    cold = table.filter(F.col(count) < HOT_ROWS)
    extra = [c for c in table.columns if c != key]
    known = rows.filter(F.col(key).isNotNull()) if nulls else rows
    met = known.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS)).cast("int")).join(hot, [key, "_salt"], "left")
    done = met.filter(F.col("_hot")).drop("_salt", "_hot")
    out = done.unionByName(met.filter(F.col("_hot").isNull()).drop("_salt", "_hot", *extra).join(cold, key, "left"))
    return out.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True) if nulls else out
