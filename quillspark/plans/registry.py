"""Registration of a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def registry() -> tuple[dict, dict, Callable]:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return queries, sqls, query
