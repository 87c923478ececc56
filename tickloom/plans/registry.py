"""All registered queries: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, tuple[Query, str | None]] = {}
_MODULES = ["series_queries", "evaluation_queries", "search_queries", "result_queries", "adaptive_queries", "scan_queries", "matrix_queries", "stretch_queries", "daily_queries"]


def register(name: str, run: Query, sql: str | None = None) -> None:
    if name in _REGISTERED:
        raise ValueError(f"query {name} is registered twice")
    _REGISTERED[name] = (run, sql)


def _all() -> dict[str, tuple[Query, str | None]]:
    for module in _MODULES:
        import_module(f"tickloom.plans.{module}")
    return _REGISTERED


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["w01_sma"](spark, sf_dir)
