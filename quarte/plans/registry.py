"""Registry of queries and their oracle SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarte.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is DuckDB SQL over the same tables."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rnd(col, digits: int = 4):
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits)


def big(col):
    """Whole number output column."""
    return (F.col(col) if isinstance(col, str) else col).cast("long")


def yes(col):
    """Boolean that is never NULL."""
    return F.coalesce(col, F.lit(False))
