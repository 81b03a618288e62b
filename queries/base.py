"""Registered queries: a Spark callable and, where SQL can say it, the same in SQL for DuckDB."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import hushframe

# Python workers get the library's functions by value: the queries also run where the package is not
# installed on the machines of the cluster.
for _package in (hushframe, sys.modules["queries"]):
    cloudpickle.register_pickle_by_value(_package)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


class Tables:
    """The given tables by name: `t.orders`."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def partial_sql(x: str) -> str:
    return f"CASE WHEN length({x}) > 4 THEN repeat('*', length({x}) - 4) || right({x}, 4) ELSE repeat('*', length({x})) END"
