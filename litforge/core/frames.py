"""Joins and numbering that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where the keys are equal; null keys are equal to each other."""
    other = right.select(*[F.col(f"`{k}`").alias(f"__key{i}") if k in keys else F.col(f"`{k}`") for i, k in enumerate(right.columns)])
    names = {k: f"__key{i}" for i, k in enumerate(right.columns) if k in keys}
    equal = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(other[names[k]]) for k in keys])
    return left.join(other, equal, how).drop(*names.values())
