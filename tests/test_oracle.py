"""Every registered query gives the rows of its SQL."""

import glob
import os

import duckdb
import pytest

from pagewright.plans.oracle import SQL
from pagewright.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def ordered(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, small, duck):
    a, b = ordered(QUERIES[name](spark, small).toPandas()), ordered(duck.sql(SQL[name]).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        assert (((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all()), c


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_part(tmp_path):
    """The entry module imports, and the page queries are there, when the optional subpackage and pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/pagewright", tmp_path / "pagewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(SQL))], said.stderr
