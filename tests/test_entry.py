"""The driver's contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 80


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"region", "n", "total"}


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_works_without_the_corpus_operators(tmp_path, left):
    gone = {".git", "llm", "corpus_pipeline.py", "__pycache__"} - set(left)
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, check=True)


@pytest.mark.parametrize("name", ["S3_scan_predicate", "J6_optional", "J8_not_exists", "A1_A8_aggregates", "O1_O4_top_k", "X2_construct"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "region", "customer", "orders", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    key = lambda row: tuple(str(round(v, 6) if isinstance(v, float) else v) for _, v in sorted(row.items()))
    got = sorted(key(r.asDict()) for r in entry.queries()[name](spark, SMALL).collect())
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert got == sorted(key(dict(zip(columns, r, strict=True))) for r in cur.fetchall())
