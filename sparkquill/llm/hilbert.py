"""Operator 6: shards cut from a Hilbert curve over quantised metadata.

Several metadata dimensions are quantised to `bits` bits each, the cell's index on the Hilbert curve orders the rows,
and equal runs of that order are the shards. Neighbours on the curve agree in all dimensions roughly, so the minima and
maxima of each shard's files are narrow in every dimension and a reader can skip files on any of them.

Only DataFrame functions are used. Global ranks come from a range partitioning of small key rows: the row's index in its
sorted partition plus the number of rows of the partitions before it (one row for each partition).

Null dimensions count as the empty string or 0. Null texts have no bytes. Equal rows are told apart by nothing and take
neighbouring slots. An empty table gives no rows. Other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.llm._stage import staged

BITS = 8


def hashed(value: Column) -> Column:
    """A category as one of 256 values."""
    return F.conv(F.substring(F.md5(F.coalesce(value, F.lit("")).cast("binary")), 1, 2), 16, 10).cast("int")


def magnitude(value: Column) -> Column:
    """A count in 4 steps for each power of two: monotone, below 256."""
    value = F.greatest(F.coalesce(value.cast("long"), F.lit(0)), F.lit(0))
    digits = F.bin(value)
    return F.when(value < 4, value).otherwise(4 * (F.length(digits) - 2) + F.conv(F.substring(digits, 2, 2), 2, 10).cast("int")).cast("int")


def _curve(axes: list[Column], bits: int) -> tuple[Column, Column, Column, Column]:
    """Skilling's transform in four steps: undo excess work (_x), Gray code (_g), last turn (_t), interleaved index."""
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(1 << b).alias("q")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        p, xi, x0 = q - 1, F.get(x, step["i"]), F.get(x, F.lit(0))
        swap = x0.bitwiseXOR(xi).bitwiseAND(p)
        return F.when(
            xi.bitwiseAND(q) != 0, F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(p)).otherwise(v))
        ).otherwise(F.transform(x, lambda v, k: F.when((k == 0) | (k == i), v.bitwiseXOR(swap)).otherwise(v)))

    x = F.aggregate(steps, F.array(*[a.cast("int") for a in axes]), undo)
    # Gray code: each axis takes the exclusive or of all axes up to it.
    gray = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.aggregate(F.slice(F.col("_x"), 1, k), F.lit(0), lambda acc, v: acc.bitwiseXOR(v)))
    turn = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0), lambda t, q: F.when(F.get(F.col("_g"), F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(1 << b).alias("q")) for b in range(bits - 1, -1, -1) for i in range(n)])
    index = F.aggregate(
        places,
        F.lit(0).cast("long"),
        lambda acc, at: acc * 2 + F.when(F.get(F.col("_g"), at["i"]).bitwiseXOR(F.col("_t")).bitwiseAND(at["q"]) != 0, 1).otherwise(0),
    )
    return x, gray, turn, index


def with_hilbert(df: DataFrame, axes: list[Column], bits: int = BITS, out: str = "curve_index") -> DataFrame:
    x, gray, turn, index = _curve(axes, bits)
    keep = df.columns
    return df.withColumn("_x", x).withColumn("_g", gray).withColumn("_t", turn).withColumn(out, index).select(*keep, out)


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> tuple[DataFrame, DataFrame]:
    """`df` with a gapless rank from 0 in the given order, and a frame of one row with the number of rows."""
    placed = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    starts = before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    total = placed.agg(F.count("*").alias("_total"))
    # one row for each partition of the sort: the number of partitions bounds what is broadcast
    ranked = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return ranked.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before"), total


def _keys(docs: DataFrame, *keep: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    return with_hilbert(
        docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *keep),
        [hashed(F.col("lang")), hashed(F.col("source")), magnitude(F.col("size"))],
    ).drop("lang", "source")


def _cut(keys: DataFrame, shards: int) -> DataFrame:
    """`keys` with shard and slot, from equal runs of the ranks along the curve."""
    ranked, total = global_rank(keys, ["curve_index", "text_crc32", "doc_id"])
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    cut = ranked.crossJoin(F.broadcast(total)).withColumn("shard", F.expr(f"(rank * {shards}) div _total"))  # total is one row
    return cut.withColumn("slot", F.col("rank") - first).withColumn("shard", F.col("shard").cast("int")).drop("rank", "_total")


def hilbert_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, curve_index, law, shard, slot, grown_shard; shard sizes in rows differ by one at most."""
    cut = _cut(staged(_keys(docs), "curve"), shards)
    return cut.select("doc_id", "size", "text_crc32", "curve_index", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Writes all rows of `docs` with their slot and curve index, sorted along the curve, one folder for each shard.

    The whole row travels with its key, so repeated and null doc_ids keep their rows; texts are shuffled once, by the
    ranges of the curve. A column of `docs` with the name shard, slot or curve_index gives way to the new one.
    """
    added = ["shard", "slot", "curve_index"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("_row")
    placed = _cut(_keys(docs, row), shards).select("_row.*", *added)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
