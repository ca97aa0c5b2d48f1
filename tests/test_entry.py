"""The driver's contract: every oracle has its query, columns agree, and the core does not need the training-data part."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tokenloom.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_agrees_with_sql(spark, name):
    rows = catalogue.queries()[name](spark, SF)
    got = sorted(str(tuple(r[c] for c in sorted(rows.columns))) for r in rows.collect())
    assert got
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    at = [names.index(n) for n in sorted(rows.columns)]
    assert sorted(str(tuple(r[i] for i in at)) for r in want.fetchall()) == got


def test_core_stands_alone(tmp_path):
    """Without the training-data part the entry still imports and has the core's queries."""
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "tokenloom", ".git"):
            os.symlink(os.path.join(ROOT, name), tmp_path / name)
    os.mkdir(tmp_path / "tokenloom")
    for name in os.listdir(os.path.join(ROOT, "tokenloom")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "tokenloom", name), tmp_path / "tokenloom" / name)
    code = "import __spark_entry__ as e; assert 'pieces_by_lang' in e.queries() and 'pipeline' not in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
