"""Writers of the export formats and tables of kept state."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litforge.operators import citations


def write_lines(rows: DataFrame, line: Column, path: str, order: list[str] | None = None, separator: str = "\n") -> None:
    """One text per row, in order if one is given (ranges of it, so files follow each other in that order)."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = rows.repartitionByRange(spread, *order).sortWithinPartitions(*order) if order else rows
    ready.select(line.alias("value")).write.mode("overwrite").option("lineSep", separator).text(path)


def write_ris(articles: DataFrame, path: str, order: list[str] | None = None) -> None:
    write_lines(articles, citations.ris(), path, order, "\r\n\r\n")


def write_bibtex(articles: DataFrame, path: str, order: list[str] | None = None) -> None:
    write_lines(articles, citations.bibtex(), path, order, "\n\n")


def write_csv(articles: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Rows of the CSV export; the header is ``citations.CSV_HEADER``."""
    write_lines(articles, citations.csv_row(), path, order)


#: Fixed value: how the lines of the matrix export end.
MATRIX_BREAK = "\r\n"


def write_cited(cited: DataFrame, papers: DataFrame, path: str, style: str = "bibtex") -> None:
    """The records of ``papers(key, …)`` that documents cite (``cited(key)``), each once, as BibTeX or RIS; cited keys without a record are left out."""
    (write_ris if style == "ris" else write_bibtex)(papers.join(cited.select("key").distinct(), "key", "left_semi"), path, ["key"])


def write_state(table: DataFrame, path: str) -> bool:
    """Writes kept rows over those of before; False where the storage refuses."""
    try:
        table.write.mode("overwrite").parquet(path)
    except (Py4JJavaError, AnalysisException):
        return False
    return True


def read_state(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Kept rows as JSON lines; malformed lines and missing files give no rows, missing fields null."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def migrated_lists(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists, saved) from the one list of earlier versions, ``entries(key, pos, note, added_at)``: it becomes the list "default"."""
    spark = entries.sparkSession
    lists = spark.createDataFrame([("default", "My reading list", 0, True)], "list_id string, name string, pos int, is_active boolean")
    return lists, entries.select(F.lit("default").alias("list_id"), "key", "pos", "note", "added_at")


def with_defaults(settings: DataFrame, defaults: dict) -> DataFrame:
    """Settings with defaults where a value is missing."""
    for name, value in defaults.items():
        column = F.array(*[F.lit(x) for x in value]) if isinstance(value, list) else F.lit(value)
        settings = settings.withColumn(name, F.coalesce(F.col(name), column) if name in settings.columns else column)
    return settings
