"""Named queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(spark, sf_dir)."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def fixed(v: Column) -> Column:
    """A double as whole millionths, so that results of two engines can be compared."""
    return F.floor(v * 1e6 + 0.5)


def fixed_sql(v: str) -> str:
    return f"CAST(floor(({v}) * 1e6 + 0.5) AS BIGINT)"
