"""All registered queries of the library and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .registry import ORACLES, QUERIES

MODULES = ("browse", "curation", "claims", "graph", "retrieval", "identity", "telemetry", "sources")


def _load() -> None:
    for name in MODULES:
        import_module(f"lumenary.plans.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["f1_priority_top"](spark, sf_dir)
