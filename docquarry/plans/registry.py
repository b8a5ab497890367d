"""Where queries and their SQL are registered, and how they read tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derived(spark: SparkSession, sf: str, name: str, select: str) -> DataFrame:
    # braces of JSON literals rule out query arguments; the view is resolved here and now
    table(spark, sf, name).createOrReplaceTempView(f"docquarry_{name}")
    return spark.sql(f"select {select} from docquarry_{name}")
