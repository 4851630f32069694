"""Registered queries and, where SQL can say it, the equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of the given tables under ``name``."""

    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def rnd(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round columns for comparison between engines."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def r(expr: str, digits: int) -> str:
    """SQL twin of ``rnd``; the added zero removes a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0e0)"


def is_key(column: str, k: int) -> Column:
    """True for every ``k``-th key: where missing values are put in on both sides."""
    return F.pmod(F.col(column), F.lit(k)) == 0
