"""Where reports are listed with the SQL that states their result."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowloom.session import ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def report(sql: str | None = None):
    """List a query function under its name; on a cluster it sends the package to the workers first."""
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A table of long texts, dealt out over the cores where it comes in fewer parts."""
    return spread(table(spark, folder, name))
