"""Tables that people paste or upload: delimiter, missing values and column types are found from the text."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Delimiters in order of preference and what stands for a missing value.
DELIMITERS = ("\t", ";", ",", "|")
MISSING = r"(?i)^(?:na|n/a|nan|null|none|-|—|\?)?\z"
NUMERIC_SHARE = 0.9


def delimiter_of(text: str) -> str:
    """The delimiter that occurs most in the first ten lines, the earlier one if equal, a comma if there is none."""
    head = "\n".join(text.split("\n")[:10])
    best = max(DELIMITERS, key=head.count)
    return best if best in head else ","


def number(cell: Column, decimal_comma: bool) -> Column:
    """A cell as a number, null if it is none; % and spaces are dropped, commas and points read as told."""
    s = F.regexp_replace(F.regexp_replace(F.trim(cell), r"%\z", ""), r"[\s\p{Z}]", "")
    s = F.regexp_replace(F.replace(s, F.lit("."), F.lit("")), "^([^,]*),", "$1.") if decimal_comma else F.replace(s, F.lit(","), F.lit(""))
    return F.when(s.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"), s.try_cast("double"))


def header_names(cells: list[str]) -> list[str]:
    """Names of columns: blank ones become "Column i", repeated ones get " (2)", " (3)", …"""
    seen: dict[str, int] = {}
    out = []
    for i, cell in enumerate(cells, 1):
        name = cell.strip() or f"Column {i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return out


def typed(table: DataFrame, decimal_comma: bool, kept: list[str] | None = None) -> DataFrame:
    """A table of texts with numeric columns as double: those of which 90 % of the present cells are numbers.

    One aggregation over all columns decides; one row per column reaches the driver. Columns ``kept`` stay as they are.
    """
    kept = kept or []
    names = [k for k in table.columns if k not in kept]
    cell = lambda k: F.when(~F.trim(F.col(f"`{k}`")).rlike(MISSING), F.trim(F.col(f"`{k}`")))
    counts = table.agg(F.array(*[F.struct(F.count(cell(k)).alias("n"), F.count(number(cell(k), decimal_comma)).alias("m")) for k in names]).alias("c")).collect()[0]["c"]
    numeric = {k for k, x in zip(names, counts, strict=True) if x["n"] > 0 and x["m"] / x["n"] >= NUMERIC_SHARE}
    shape = lambda k: F.col(f"`{k}`") if k in kept else number(cell(k), decimal_comma) if k in numeric else cell(k)
    return table.select(*[shape(k).alias(k) for k in table.columns])


def read_text(spark: SparkSession, text: str) -> DataFrame:
    """A pasted table, with column row_id for its order. Needs a header and a row; blank rows are left out."""
    text = text.strip().lstrip("﻿")
    sep = delimiter_of(text)
    rows = [r for r in csv.reader(io.StringIO(text, newline=None), delimiter=sep) if any(x.strip() for x in r)]
    if len(rows) < 2:
        raise ValueError("a table needs a header and at least one row")
    names = header_names(rows[0])
    schema = T.StructType([T.StructField("row_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in names]])
    body = [(i, *[r[j] if j < len(r) else "" for j in range(len(names))]) for i, r in enumerate(rows[1:])]
    frame = spark.createDataFrame(body, schema)
    return typed(frame, sep != ",", ["row_id"])


def read_file(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """A delimited file, with column row_id for its order; the delimiter and the header come from its first lines.

    Lines are read in parallel, so a file may be of any size. Only with ``line_breaks`` may quoted cells hold line breaks; a
    file is then read by one task. Blank rows and the header of every file of a folder are left out.
    """
    head = "\n".join(r[0] for r in spark.read.text(path).limit(10).collect()).lstrip("﻿")
    sep = delimiter_of(head)
    first = next((r for r in csv.reader(io.StringIO(head), delimiter=sep) if any(x.strip() for x in r)), None)
    if first is None:
        raise ValueError("a table needs a header and at least one row")
    places = [f"c{i}" for i in range(len(first))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in places])
    raw = spark.read.schema(schema).option("sep", sep).option("quote", '"').option("escape", '"').option("header", "false").option("multiLine", str(line_breaks).lower()).csv(path)
    told = F.concat_ws("", *[F.trim(F.coalesce(n, F.lit(""))) for n in places])
    cell = lambda n: F.coalesce(F.ltrim(F.col(n), F.lit("\ufeff")), F.lit(""))
    is_head = reduce(lambda a, b: a & b, [cell(n) == x for n, x in zip(places, first, strict=True)])
    rows = raw.withColumn("__row", F.monotonically_increasing_id()).where((told != "") & ~is_head)
    named = rows.toDF(*header_names(first), "__row")
    # typed by the texts alone, the row number beside them
    return typed(named, sep != ",", ["__row"]).select(F.col("__row").alias("row_id"), *[f"`{n}`" for n in header_names(first)])
