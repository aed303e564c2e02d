"""Registration of queries: a name, the tables that it reads, a function of those tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import adapter, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None) -> Callable:
    """Register a function of DataFrames as a query over the named tables or adapters."""
    names = tuple(tables.split())

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(adapter(spark, sf_dir, n) for n in names))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = oracle(names, sql)
        return f

    return wrap
