"""Column expressions for text that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z"


def normal_form(value: Column) -> Column:
    """Lower case, whitespace runs as one space, everything but letters and digits stripped from both ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), SPACE, " "), EDGES, "")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
