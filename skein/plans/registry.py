"""Queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ratio_sql(a: str, b: str) -> str:
    """SQL of the similarity of functions.fuzzy for two columns: the usual table of common subsequences, a row for each character of a."""
    chars = f"list_transform(string_split({a}, ''), lambda x: list_transform(string_split({b}, ''), lambda y: CASE WHEN x = y THEN 1 ELSE 0 END))"
    step = "lambda acc, eq: list_transform(range(1, len(eq) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(acc[k], coalesce(acc[k - 1], 0) + eq[k]))))"
    return f"200.0 * list_last(list_reduce(list_concat([list_transform(string_split({b}, ''), lambda y: 0)], {chars}), {step})) / (length({a}) + length({b}))"
