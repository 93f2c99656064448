import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the provided tables")
def test_flagship_query_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the provided tables")
@pytest.mark.parametrize("name", ["chunk_words", "bm25_topk", "evidence_resolve", "answer_summary", "apply_reviews", "citation_check", "response_build", "section_split", "running_lines", "store_versions", "gold_file", "chunk_file"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "orders", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    mine = entry.queries()[name](spark, SMALL)
    theirs = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(mine.columns)

    def rows(found):
        return sorted(tuple("" if v is None else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in found)

    assert [tuple(map(str, r)) for r in rows(mine.select(*columns).collect())] == [tuple(map(str, r)) for r in rows(theirs.fetchall())]


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    """A copy without the subpackage and the pipeline still registers the other queries."""
    import shutil
    import subprocess
    import sys

    shutil.copytree(f"{HERE}/sparkquill", tmp_path / "sparkquill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
    assert said.stdout.split()[1:] == ["False"] and int(said.stdout.split()[0]) >= 40, said.stderr


def test_the_rest_of_the_suite_passes_without_the_corpus_operators(tmp_path):
    """A copy without the subpackage, its tests and the pipeline: its entry and text tests run."""
    import shutil
    import subprocess
    import sys

    shutil.copytree(f"{HERE}/sparkquill", tmp_path / "sparkquill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(f"{HERE}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    run = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_text.py", "tests/test_entry.py::test_every_oracle_has_a_query", "tests/test_documents_answers.py::test_gate"]
    said = subprocess.run(run, cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=600)
    assert said.returncode == 0, said.stdout[-2000:]
