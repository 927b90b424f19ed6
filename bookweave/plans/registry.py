"""Registered queries: a Spark query and, where SQL can say it, the DuckDB text for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if oracle:
            ORACLES[name] = with_views(oracle, "duckdb")
        return fn

    return register


def load() -> None:
    from . import catalog, contents, layouts, pages, scalars, streams, tasks  # noqa: F401
