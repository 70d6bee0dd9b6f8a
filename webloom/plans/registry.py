"""Registry of queries: name → Spark query over the tables of a folder, and its oracle SQL if any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.plans.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **types: str):
    """Register ``fn(tables) -> DataFrame`` under a name; ``types`` are column types of the oracle."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({oracle})" if casts else oracle
        return fn

    return register
