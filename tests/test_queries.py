"""Every registered image query against its SQL in DuckDB, and its rows alone where there is no SQL."""

import glob
import os

import duckdb
import pytest

from rasterloom.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in map(lambda x: x.item() if hasattr(x, "item") else x, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert got.count() > 0
        return
    want = duck.sql(ORACLES[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_alone(tmp_path):
    """Without the text operators and the pipeline everything else imports."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/rasterloom", tmp_path / "rasterloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) == len(QUERIES)
