"""Operator 1: WARC archives, and their parallel reading by boundary-chain verification.

Writing: one record for each page, as text files whose separator is the end of a record. Of pages with equal payloads of
at least REVISIT_BYTES bytes, the one with the largest page_id is the response; the others become revisit records without payload.

Reading: files are split anywhere. Every occurrence of the magic line is a candidate; tasks emit its offset and that of
its successor, which follows from Content-Length. A magic line inside a payload is a candidate too, but nothing leads to
it: only candidates that are reached from the file's start are records. Candidates whose successor is the very next one in
their block form a run; pointer jumping (each round doubles the pointers) over the runs' entries finds the reachable
ones. Records whose payload holds a magic line are torn into several segments. A second scan, made only if there are any,
fetches the contents of those segments by their digest, so it may split the files otherwise than the first; an error
is raised when a record can't be put together again, or when a payload differs from the digest that its record claims.

A revisit has the payload of a response with the page_id that it refers to and the digest that it claims; where the archives
hold none, payload_bytes and payload_digest are null. Null payloads are empty, null urls too; line breaks in urls are percent-encoded. Rows that repeat with one page_id and payload are
all responses. A null page_id counts as the smallest. A file that doesn't begin with a record has none. Empty tables give
no records. Payload hashes are over the whole payload. Other columns of the input are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquill.llm._stage import drop_path, drop_staged, new_path, salted_lookup, staged

MAGIC = "WARC/1.1\r\n"
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload another page holds for them."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keys = staged(pages.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size")).filter(F.col("size") >= REVISIT_BYTES), "digests")
    shared = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    met = salted_lookup(keys.select("digest", "page_id"), shared, "digest", "page_id", "n")
    again = met.filter(F.col("refers_to").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))).select("page_id", "digest", "refers_to").distinct()
    out = staged(again, "revisits")
    drop_staged(keys)
    return out


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) to a folder of uncompressed WARC files."""
    held = revisits(pages)
    again = held.withColumnRenamed("page_id", "_page").withColumnRenamed("digest", "_digest")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    # by the size of `again` on disk, Spark sends it to all tasks or shuffles both sides
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    again_row = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(again_row, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(again_row, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")), F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again_row, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit("\r\n\r\n"), http, body,
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
    drop_staged(held)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magic lines, in the order of the file within each block."""
    return (
        spark.read.option("lineSep", MAGIC).text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .withColumn("at", F.monotonically_increasing_id())
    )


def _header(name: str) -> Column:
    return F.regexp_extract("head", f"(?im)^{name}:[ \\t]*([^\\r\\n]*)", 1)


def _parsed(df: DataFrame, value: str = "value") -> DataFrame:
    """head_bytes, length, page_id, type, refers_to, claimed digest; payload bytes and digest where the whole record lies in `value`."""
    df = df.withColumn("head", F.substring_index(value, "\r\n\r\n", 1))
    df = df.withColumn("head_bytes", F.octet_length("head").cast("long") + 4).withColumn("length", F.expr("try_cast(nullif(regexp_extract(head, '(?im)^Content-Length:[ \\\\t]*([0-9]+)', 1), '') AS BIGINT)"))
    whole = F.octet_length(value) >= F.col("head_bytes") + F.col("length")
    raw = F.when(whole, F.expr(f"substring(CAST({value} AS BINARY), CAST(head_bytes + 1 AS INT), CAST(length AS INT))"))
    df = df.withColumn("body", raw)
    http = F.octet_length(F.substring_index(F.expr("CAST(body AS STRING)"), "\r\n\r\n", 1)) + 4
    df = df.withColumn("http_bytes", http).withColumn("payload", F.expr("substring(body, http_bytes + 1)"))
    number = "try_cast(nullif(regexp_extract({}, 'urn:page:(-?[0-9]+)', 1), '') AS BIGINT)"
    return df.select(
        *[c for c in df.columns if c not in (value, "head", "body", "payload", "http_bytes")],
        _header("WARC-Type").alias("record_type"), _header("WARC-Record-ID").alias("record_id"), _header("WARC-Refers-To").alias("refers_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), _header("WARC-Payload-Digest").alias("claimed"),
    ).withColumn("page_id", F.expr(number.format("record_id"))).withColumn("refers_to", F.expr(number.format("refers_id"))).drop("record_id", "refers_id")


def _name(value: str) -> Column:
    """A 128-bit name of a segment's content."""
    return F.unhex(F.md5(F.col(value).cast("binary")))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every magic line with its file offset, the offset of its successor, the parsed record and the name of its segment's content."""
    found = staged(_parsed(_segments(spark, path).withColumn("size", F.octet_length("value").cast("long")).withColumn("content", _name("value"))), "candidates")
    here = Window.partitionBy("file", "block").orderBy("at")
    inside = found.withColumn("inside", F.sum(F.col("size") + len(MAGIC)).over(here) - F.col("size") - len(MAGIC)).drop("at")
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    base = blocks.withColumn("base", F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bytes")
    placed = inside.join(base, ["file", "block"]).withColumn("offset", F.col("base") + F.col("inside") - len(MAGIC))
    placed = placed.filter("offset >= 0").withColumn("next", F.col("offset") + len(MAGIC) + F.col("head_bytes") + F.col("length") + 4).drop("base", "inside")
    out = staged(placed, "offsets")
    drop_staged(found)
    return out


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain from the start of their file reaches."""
    here = Window.partitionBy("file", "block").orderBy("offset")
    linked = found.withColumn("_step", F.coalesce(F.lead("offset").over(here) == F.col("next"), F.lit(False)))
    runs = linked.withColumn("_run", F.coalesce(F.sum(F.when(F.col("_step"), 0).otherwise(1)).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = staged(runs, "runs")
    ends = runs.filter(~F.col("_step")).select("file", "block", "_run", "next")
    entries = ends.select("file", F.col("next").alias("offset")).union(runs.select("file", F.lit(0).cast("long")).distinct()).distinct()
    # pointers from the entry of a run to the entry that its last record leads to
    all_jumps = staged(runs.join(entries, ["file", "offset"]).select("file", "block", "_run", "offset").join(ends, ["file", "block", "_run"]).select("file", "offset", "next"), "jumps")
    held = all_jumps.join(all_jumps.select("file", F.col("offset").alias("next")).distinct(), ["file", "next"], "left_semi").select("file", "offset", "next")
    reached = staged(runs.filter("offset = 0").select("file", "offset"), "reached")
    jump = staged(held, "jumps")
    drop_staged(all_jumps)
    while not jump.isEmpty():
        more = reached.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        old, reached = reached, staged(reached.union(more).distinct(), "reached")
        left = jump.select("file", F.col("offset").alias("from"), F.col("next").alias("offset"))
        short, jump = jump, staged(left.join(jump, ["file", "offset"]).select("file", F.col("from").alias("offset"), "next"), "jumps")
        drop_staged(old, short)
    first = runs.join(reached, ["file", "offset"]).groupBy("file", "block", "_run").agg(F.min("offset").alias("_from"))
    out = staged(runs.join(first, ["file", "block", "_run"]).filter("offset >= _from").drop("_step", "_run", "_from"), "records")
    drop_staged(runs, reached, jump)
    return out


def _owned(found: DataFrame, torn: DataFrame) -> DataFrame:
    """The segments of torn records: file, first (the record's offset), offset, content. Each candidate belongs to the last torn
    record that begins at or before it, in its own block or, by a window over blocks, in an earlier one; records don't overlap."""
    here = Window.partitionBy("file", "block").orderBy("offset")
    marked = found.select("file", "block", "offset", "content").join(torn.select("file", "offset", F.col("next").alias("_end")), ["file", "offset"], "left")
    marked = marked.withColumn("_own", F.last(F.when(F.col("_end").isNotNull(), F.struct("offset", "_end")), ignorenulls=True).over(here))
    last = marked.filter("_end IS NOT NULL").groupBy("file", "block").agg(F.max(F.struct("offset", "_end")).alias("_last"))
    blocks = marked.select("file", "block").distinct().join(last, ["file", "block"], "left")
    before = blocks.withColumn("_before", F.last("_last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    owner = marked.join(before, ["file", "block"]).withColumn("_own", F.coalesce("_own", "_before"))
    return owner.filter("offset < _own._end").select("file", F.col("_own.offset").alias("first"), "offset", "content")


def _assembled(spark: SparkSession, path: str, found: DataFrame, torn: DataFrame) -> DataFrame:
    """The torn records, parsed again from all their segments, whose contents a second scan of the files fetches by name."""
    pieces = staged(_owned(found, torn), "pieces")
    wanted = pieces.groupBy("content").agg(F.count("*").alias("n"))
    texts = _segments(spark, path).select(_name("value").alias("content"), "value").join(wanted.select("content"), "content", "left_semi")
    texts = staged(texts.groupBy("content").agg(F.first("value").alias("value")).join(wanted, "content"), "contents")
    met = salted_lookup(pieces, texts, "content", "offset", "n")
    joined = met.groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))  # one record's segments
    out = staged(_parsed(joined.select(F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value"))), "assembled")
    drop_staged(pieces, texts)
    n, whole = torn.count(), out.filter("payload_digest IS NOT NULL").count()
    if n != whole:
        raise RuntimeError(f"{n - whole} of {n} records that hold a magic line couldn't be put together: did the archives change while they were read?")
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; a revisit has the payload of the record it refers to."""
    found = candidates(spark, path)
    records = reachable(found)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "claimed"]
    complete = records.filter("payload_digest IS NOT NULL").select(*columns)
    torn = records.filter("payload_digest IS NULL AND length IS NOT NULL").select("file", "offset", "next")
    parts = [] if torn.isEmpty() else [_assembled(spark, path, found, torn)]
    for part in parts:
        complete = complete.unionByName(part.select(*columns))
    wrong = (F.col("record_type") != "revisit") & F.col("claimed").rlike("^[0-9a-f]{40}$") & (F.col("claimed") != F.col("payload_digest"))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("the payload of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" differs from its digest"))).cast("string")).otherwise(F.col("payload_digest"))
    complete = staged(complete.withColumn("claimed", F.regexp_replace("claimed", "^sha1:", "")).withColumn("payload_digest", checked), "payloads")
    drop_staged(found, records, *parts)
    again = complete.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.struct("refers_to", "claimed").alias("held"))
    plain = complete.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    counted = again.groupBy("held").agg(F.count("*").alias("n"))
    held = plain.select(F.struct(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("claimed")).alias("held"), "payload_bytes", "payload_digest").distinct().join(counted, "held")
    resolved = salted_lookup(again, held, "held", "page_id", "n")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.select(*out).unionByName(resolved.select(*out))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives, reads them back and deletes the archives; the result rests on the table of payload digests alone."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)
    out = read_warc(spark, path)
    drop_path(spark, path)
    return out
