"""The named queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' sums compare equal, undefined numbers null, whole numbers as bigint."""
    fix = lambda k: F.round(F.nanvl(F.col(f"`{k}`"), F.lit(None).cast("double")), digits).alias(k)
    whole = ("tinyint", "smallint", "int", "bigint")
    return df.select(*[fix(k) if kind == "double" else F.col(f"`{k}`").cast("bigint").alias(k) if kind in whole else F.col(f"`{k}`") for k, kind in df.dtypes])


def query(sql: str | None = None, digits: int = 6):
    """Registers a function of (spark, folder) under its name; its numbers are rounded to ``digits``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return rounded(f(spark, sf), digits)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add
