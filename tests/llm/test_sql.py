"""The text operators' queries against their SQL in DuckDB."""

import duckdb
import pytest

from rasterloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == sorted(repr(tuple(r)) for r in want.select(*columns).fetchall())
