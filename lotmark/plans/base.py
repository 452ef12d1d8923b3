"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotmark.sources.tables import Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the model as a query, with the SQL that gives the same rows."""

    def add(f: Callable[[Model], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add
