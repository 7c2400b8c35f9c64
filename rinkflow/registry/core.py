"""Registry of the queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, doubles: str = "", places: int = 6):
    """Register a query. Both sides round the listed columns, so that the order of sums does not matter."""
    rounded = doubles.split()

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, path: str) -> DataFrame:
            out = fn(spark, path)
            # Adding zero turns a negative zero into a plain one.
            return out.withColumns({c: F.round(F.col(c).cast("double"), places) + F.lit(0.0) for c in rounded})

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            swaps = ", ".join(f"round(CAST({c} AS DOUBLE), {places}) + 0.0 AS {c}" for c in rounded)
            ORACLES[name] = f"SELECT * REPLACE ({swaps}) FROM ({sql})" if rounded else sql
        return fn

    return wrap
