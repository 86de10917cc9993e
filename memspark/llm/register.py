"""Register of this package's queries and of the SQL that gives the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, table: str = "documents"):
    """Register ``fn(table) -> DataFrame``, applied to the whole table, under ``name``."""

    def add(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
