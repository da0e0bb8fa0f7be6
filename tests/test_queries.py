"""Every registered query with an SQL twin gives the twin's rows on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from maskloom import registry

TABLES = "lineitem orders part events embeddings pages conversations documents".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return v if v is None or isinstance(v, (str, bool, int)) else str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in con.sql(registry.SQL[name]).select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    assert got == want


def test_entry_imports_without_the_llm_folders(tmp_path):
    """A copy of the repository without the training-data folders and corpus_pipeline.py has all other queries."""
    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "maskloom", tmp_path / "maskloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.SQL))]
