"""Collects the named queries of the plan modules and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("episodes", "statistics", "poses", "messages", "shards", "rollouts", "datasets", "texts", "files")
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with the SQL that DuckDB runs for the same rows."""

    def add(f):
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"roboframe.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes -> padded windows -> masks -> statistics per step."""
    return queries()["D01_masked_moments"](spark, sf_dir)
