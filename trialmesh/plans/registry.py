"""Registry of named queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: Sequence[str] = (), digits: int = 6):
    """Register a query. Sums of doubles depend on their order, so both sides round the columns in ``rounded``."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in rounded}) if rounded else df

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            parts = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in rounded)
            ORACLES[name] = f"SELECT * REPLACE ({parts}) FROM ({sql})" if rounded else sql
        return run

    return register
