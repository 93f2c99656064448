"""Versioned stores and numbered lines against plain Python."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkquill.sources import lines, store
from sparkquill.sources.versions import VersionedStore

ROW = "chunk_id string, text string, embedding double"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(os.path.join(path, "rows")) for f in names if f.endswith(".parquet")}


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    s = VersionedStore(spark, path)
    first = [(f"c{i}", f"text {i}", float(i)) for i in range(400)]
    v1 = s.create(spark.createDataFrame(first, ROW), "chunk_id", 32)
    before, opened = files(path), s.read()
    new = [("c7", "changed", None), ("c8", None, 1.0), ("added", "new", None)]
    v2 = s.merge(spark.createDataFrame(new, ROW), keep_old=("embedding",))
    changed = {b for b in v2.writes if v2.writes[b] != v1.writes.get(b)}
    assert 1 <= len(changed) <= 3 and before < files(path) and len(files(path) - before) == len(changed)
    want = {k: (k, t, e) for k, t, e in first} | {"c7": ("c7", "changed", 7.0), "c8": ("c8", None, 1.0), "added": ("added", "new", None)}
    assert rows_of(s.read().select("chunk_id")) == sorted((k,) for k in want)
    assert {r.chunk_id: tuple(r) for r in s.read().collect()} == want
    assert rows_of(opened) == rows_of(s.read(1)) == sorted(first)  # readers of the old version keep it
    assert s.read().schema == s.read(1).schema and s.versions() == [1, 2]
    assert s.vacuum() == [w for w in {v1.writes[b] for b in v1.writes} if w not in v2.writes.values()]
    assert {r.chunk_id: tuple(r) for r in s.read().collect()} == want


def test_a_complete_table_takes_out_stale_rows_in_the_same_step(spark, tmp_path):
    s = VersionedStore(spark, str(tmp_path / "store"))
    s.create(spark.createDataFrame([("a", "1", 1.0), ("b", "2", 2.0), ("c", "3", None)], ROW), "chunk_id", 4)
    s.merge(spark.createDataFrame([("a", "9", None), ("d", "4", None)], ROW), ("embedding",), complete=True)
    assert rows_of(s.read()) == [("a", "9", 1.0), ("d", "4", None)] and s.version().number == 2
    s.merge(spark.createDataFrame([], ROW), complete=True)
    assert s.read().count() == 0 and s.read().columns == ["chunk_id", "text", "embedding"] and s.read(2).count() == 2
    s.merge(spark.createDataFrame([("z", "back", 0.5)], ROW))
    assert rows_of(s.read()) == [("z", "back", 0.5)]
    assert s.vacuum(keep=2) and s.versions() == [3, 4]
    with pytest.raises(ValueError, match="no version 1"):
        s.read(1)


def test_stores_refuse_what_they_cannot_keep(spark, tmp_path):
    s = VersionedStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="no version in"):
        s.read()
    with pytest.raises(ValueError, match="chunk_id a occurs 2 times"):
        s.create(spark.createDataFrame([("a", "1", 1.0), ("a", "2", 2.0)], ROW), "chunk_id", 2)
    v1 = s.create(spark.createDataFrame([("a", "1", 1.0)], ROW), "chunk_id", 2)
    with pytest.raises(ValueError, match="a null chunk_id"):
        s.merge(spark.createDataFrame([(None, "1", 1.0)], ROW))
    with pytest.raises(ValueError, match="another writer"):
        s._commit(v1)
    assert s.versions() == [1] and not [n for n in os.listdir(tmp_path / "store" / "versions") if n.startswith(".") and not n.endswith(".crc")]


def test_the_width_of_vectors_is_kept_in_the_schema(spark, tmp_path):
    from sparkquill.sources import readers

    path = str(tmp_path / "vectors")
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, embedding array<double>")
    readers.with_width(v, "embedding", 2).write.parquet(path)
    kept = spark.read.parquet(path)
    assert readers.kept_width(kept, "embedding") == 2 and readers.vector_width(kept, "embedding", 2).count() == 2
    with pytest.raises(ValueError, match="vectors of 2 values, not 3"):
        readers.vector_width(kept, "embedding", 3)  # no task has run
    with pytest.raises(Exception, match="2 values, not 3"):
        readers.vector_width(v, "embedding", 3).collect()  # without the metadata, the rows tell
    with pytest.raises(Exception, match="2 values, not 3"):
        readers.with_width(v, "embedding", 3).collect()


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    texts = {"a.txt": [f"line {i} " + "x" * (i * 7 % 90) for i in range(120)], "b.txt": ["", "one", "", "two"], "c.txt": ["y" * 2000, "after"], "d.txt": []}
    for name, body in texts.items():
        (tmp_path / name).write_text("".join(t + "\n" for t in body))
    read = lines.read_lines(spark, str(tmp_path))
    got = {(os.path.basename(r.file), r.line_no): r.value for r in read.collect()}
    assert got == {(n, i + 1): t for n, body in texts.items() for i, t in enumerate(body)}


def gold(i, **other):
    return {"id": f"g{i}", "question": "why?", "kind": "factual", "evidence": [{"paper_id": "p", "page": 1, "quote": "a quote of enough characters"}]} | other


def test_bad_gold_lines_are_named(spark, tmp_path, small_splits):
    body = [json.dumps(gold(i)) for i in range(60)]
    bad = {
        21: ("{not json", "not a row of the schema"), 25: (json.dumps(gold(25, evidence=[{"paper_id": "p", "page": "one", "quote": "a quote of enough characters"}])), "not a row of the schema"),
        31: (json.dumps(gold(31, kind="odd")), "no such kind: odd"), 33: (json.dumps(gold(33, status="maybe")), "no such status: maybe"), 37: (json.dumps(gold(37, evidence=[])), "answerable question without evidence"),
        41: (json.dumps({"id": "g41"}), "no question"), 43: (json.dumps(gold(43, evidence=[{"paper_id": "p", "page": 1}])), "evidence without paper_id, page or quote"), 47: (json.dumps(gold(7)), "already"), 48: (json.dumps(gold(7)), "already"), 49: ("[1]", "not a row of the schema"),
    }
    body[5] = "   "
    for n, (line, _) in bad.items():
        body[n] = line
    (tmp_path / "gold.jsonl").write_text("\n".join(body))
    rows, problems = lines.gold_with_problems(spark, str(tmp_path / "gold.jsonl"))
    found = {r.line_no - 1: r.reason for r in problems.collect()}
    assert set(found) == set(bad) and all(found[n].endswith(reason) for n, (_, reason) in bad.items()), found
    assert found[48].startswith("id g7 stands in ") and "gold.jsonl:8 already" in found[48]
    assert sorted(r.id for r in rows.collect()) == sorted(f"g{i}" for i in range(60) if i not in bad and i != 5)
    with pytest.raises(ValueError, match=r"gold\.jsonl:22: not a row of the schema"):
        lines.read_gold_strict(spark, str(tmp_path / "gold.jsonl"))
    good = tmp_path / "good.jsonl"
    good.write_text("\n".join(json.dumps(gold(i)) for i in range(3)))
    assert {r.status for r in lines.read_gold_strict(spark, str(good)).collect()} == {"verified"}


def test_chunks_are_read_back(spark, tmp_path):
    c = spark.createDataFrame([("c1", "p", "s", 1, "text\n with \"marks\" — é"), ("c2", "p", "s", 0, "t"), ("c3", "p", "s", 1, None)], "chunk_id string, paper_id string, section string, page int, text string")
    store.write_jsonl(c, str(tmp_path / "chunks"))
    rows, problems = lines.chunks_with_problems(spark, str(tmp_path / "chunks"))
    assert rows_of(rows) == rows_of(c.filter("chunk_id = 'c1'"))
    assert sorted(r.reason for r in problems.collect()) == ["a page below 1", "no text"]


def test_spot_checks_pick_as_pythons_generator_does(spark):
    import random

    from sparkquill.operators.answers import spot_check_passages

    results = spark.createDataFrame([(f"q{i:03d}", None if i % 5 == 0 else "yes", [f"c{i}", "gone", "c1"], 0.5, [("claim", True)] if i % 3 else None) for i in range(90)], "qid string, answer string, cited_chunk_ids array<string>, faithfulness double, claims array<struct<claim:string,supported:boolean>>")
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(90)], "chunk_id string, text string")
    judged = [f"q{i:03d}" for i in range(90) if i % 5 and i % 3]
    for seed, n in ((0, 5), (3, 20), (3, 500)):
        got = spot_check_passages(results, chunks, n, seed).orderBy("pick").collect()
        assert [r.qid for r in got] == random.Random(seed).sample(judged, min(n, len(judged)))
        for r in got:
            i = int(r.qid[1:])
            assert [tuple(p) for p in r.cited_passages] == [(f"c{i}", f"text {i}"), ("c1", "text 1")] and r.human_supported is None
    assert spot_check_passages(results.limit(0), chunks, 5).count() == 0
    assert spot_check_passages(results, chunks.limit(0), 5).filter(F.size("cited_passages") == 0).count() == 5
