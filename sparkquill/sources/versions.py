"""A chunk store in versions: rows in buckets of their key's hash, a manifest for each version, buckets rewritten only where they change.

    <path>/rows/<write>/_bucket=<n>/*.parquet     the buckets that one write made
    <path>/versions/<version>.json                key, number of buckets, schema, and for each bucket the write that holds it

A version exists once its manifest does, and a manifest is put in place by a rename, so readers see a version whole or not at all and keep the one they opened.
Of two writers on the same version one gets an error and nothing of it is seen.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkquill.sources import store

BUCKET = "_bucket"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Version:
    number: int
    key: str
    buckets: int
    schema: StructType
    writes: dict[int, str]  # bucket -> the write that holds it; a bucket without rows has none


class VersionedStore:
    """The versions under one path. `merge` makes the next one; `read` returns the rows of the newest, or of an earlier one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        at, fs = _fs(self.spark, f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        known = self.versions()
        if not known or (number is not None and number not in known):
            raise ValueError(f"no version {'' if number is None else number} in {self.path}".replace("  ", " "))
        number = known[-1] if number is None else number
        held = json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.path}/versions/{number}.json", wholetext=True).collect()))  # a line for each bucket
        return Version(number, held["key"], held["buckets"], StructType.fromJson(held["schema"]), {int(b): w for b, w in held["writes"].items()})

    def read(self, number: int | None = None) -> DataFrame:
        v = self.version(number)
        return self._rows(v, sorted(v.writes))

    def create(self, rows: DataFrame, key: str, buckets: int) -> Version:
        """Version 1. Keys are unique and not null, else an error; choose buckets so that one fits a task well."""
        if self.versions():
            raise ValueError(f"{self.path} has versions already")
        _unique(rows, key)
        return self._commit(Version(1, key, buckets, rows.schema, self._write(rows, key, buckets)))

    def merge(self, new: DataFrame, keep_old: tuple[str, ...] = (), complete: bool = False) -> Version:
        """The next version: rows of `new` are put in by key, with the old value where one of a keep_old column is null; a `complete` table also takes
        out the rows whose key it no longer has. Only buckets with such rows are read and written; rows without a change in them stay in their files.
        """
        old = self.version()
        _unique(new, old.key)
        key, at = old.key, _bucket(old.key, old.buckets)
        touched = new.select(at.alias("b"))
        if complete:
            touched = touched.unionByName(store.stale(self._rows(old, sorted(old.writes)).select(key), new, key).select(at.alias("b")))
        numbers = sorted(r["b"] for r in touched.distinct().collect())  # at most as many as there are buckets
        held = self._rows(old, [b for b in numbers if b in old.writes])
        kept = held.join(new.select(key), key, "left_semi") if complete else held
        made = self._write(store.upsert(kept, new, key, [c for c in keep_old if c in new.columns]).select(*held.columns), key, old.buckets)
        writes = {b: w for b, w in old.writes.items() if b not in numbers} | made
        return self._commit(Version(old.number + 1, key, old.buckets, old.schema, writes))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the manifests of all but the newest `keep` versions, then writes that no version names; readers of those fail. Returns the deleted writes."""
        known = self.versions()
        gone, stay = known[:-keep], known[-keep:]
        for number in gone:
            at, fs = _fs(self.spark, f"{self.path}/versions/{number}.json")
            fs.delete(at, False)
        used = {w for n in stay for w in self.version(n).writes.values()}
        at, fs = _fs(self.spark, f"{self.path}/rows")
        dropped = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName() not in used)
        for name in dropped:
            fs.delete(_fs(self.spark, f"{self.path}/rows/{name}")[0], True)
        return dropped

    def _rows(self, v: Version, buckets: list[int]) -> DataFrame:
        paths = [f"{self.path}/rows/{v.writes[b]}/{BUCKET}={b}" for b in buckets]
        return self.spark.read.schema(v.schema).parquet(*paths) if paths else self.spark.createDataFrame([], v.schema)

    def _write(self, rows: DataFrame, key: str, buckets: int) -> dict[int, str]:
        """Writes rows by bucket and returns the buckets that have any. One shuffle, by bucket; a bucket is one file."""
        name = uuid.uuid4().hex
        target = f"{self.path}/rows/{name}"
        rows.withColumn(BUCKET, _bucket(key, buckets)).repartition(F.col(BUCKET)).sortWithinPartitions(BUCKET, key).write.partitionBy(BUCKET).option("compression", "zstd").parquet(target)
        at, fs = _fs(self.spark, target)
        return {int(s.getPath().getName().split("=")[1]): name for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{BUCKET}=")}

    def _commit(self, v: Version) -> Version:
        text = json.dumps({"key": v.key, "buckets": v.buckets, "schema": v.schema.jsonValue(), "writes": {str(b): w for b, w in sorted(v.writes.items())}})
        folder, fs = _fs(self.spark, f"{self.path}/versions")
        fs.mkdirs(folder)
        draft, final = _fs(self.spark, f"{self.path}/versions/.{uuid.uuid4().hex}")[0], _fs(self.spark, f"{self.path}/versions/{v.number}.json")[0]
        out = fs.create(draft, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise ValueError(f"version {v.number} of {self.path} was written by another writer")
        return v


def _unique(rows: DataFrame, key: str) -> None:
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1)).first()
    if twice is not None:
        raise ValueError(f"a null {key}" if twice[key] is None else f"{key} {twice[key]} occurs {twice['n']} times")
