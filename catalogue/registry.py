"""Named queries: a Spark callable each, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalogue.sql import query as with_steps
from catalogue.views import new_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it is only checked by the tests."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            new_query()
            return function(spark, sf_dir)

        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_steps(sql)
        return function

    return add

