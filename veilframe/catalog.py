"""Registry of the queries over the relational tables and of their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe import runtime
from veilframe.plans import learning, loading, marts, privacy, releases, statistics

Query = Callable[[SparkSession, str], DataFrame]
_FAMILIES = (loading, statistics, privacy, releases, learning, marts)


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        runtime.ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    """Key -> callable(spark, sf_dir)."""
    return {name: _shipped(f) for family in _FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Key -> DuckDB SQL over the registered views."""
    return {name: text for family in _FAMILIES for name, text in family.SQL.items()}
