"""Registered queries: id -> function of (spark, sf_dir), and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalquarry.bindings import Evidence, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def on(binding: str, sql: str | None = None, *, name: str | None = None):  # noqa: ANN201
    """Register a function of the Evidence of a binding; sql follows the binding's tables."""

    def register(f: Callable[[Evidence], DataFrame]):  # noqa: ANN202
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: f(Evidence(spark, sf_dir, binding))
        if sql is not None:
            ORACLE_SQL[key] = oracle(binding, sql)
        return f

    return register
