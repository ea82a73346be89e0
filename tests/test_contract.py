"""The driver's contract: every query against its SQL, and the repository without its optional parts."""

import glob
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from veilwork.oracles import ORACLES
from veilwork.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def shown(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return str(value)[:19] if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(ORACLES[name])
    theirs = [d[0] for d in result.description]
    rows = [dict(zip(theirs, r)) for r in result.fetchall()]
    assert columns == sorted(theirs)
    assert mine == sorted((tuple(shown(r[c]) for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).collect() is not None


def test_entry(spark):
    assert contract.entry(spark).count() > 0 and set(contract.oracle_sql()) <= set(contract.queries())


def test_without_the_optional_parts(tmp_path):
    """The rest imports where the training-data parts have been deleted."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') or n == 'pipeline' for n in q), q; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
    assert done.returncode == 0, done.stderr


def test_without_a_library_of_the_optional_parts():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert e.queries() and 'op9_covering_simhash' not in e.queries()"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ROOT})
    assert done.returncode == 0, done.stderr
