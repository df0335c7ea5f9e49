"""Streams: papers new since earlier runs, and counts of events by time with late data."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(papers: DataFrame, key: str = "pmid", time: str = "fetched_at", late: str | None = None) -> DataFrame:
    """Each paper once, when it first arrives; with ``late`` keys older than that are forgotten."""
    if late:
        return papers.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return papers.dropDuplicates([key])


def windowed_counts(events: DataFrame, time: str, kind: str, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, kind, n, total of a stream of events by tumbling (or sliding) windows; works on a table as well."""
    value = F.sum("value").alias("total") if "value" in events.columns else F.lit(None).cast("double").alias("total")
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, size, slide).alias("w"), kind).agg(F.count("*").alias("n"), value).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, start, end, n of runs of events without a longer gap."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def keep_new(batch: DataFrame, path: str, key: str = "pmid") -> None:
    """``foreachBatch`` step: appends the papers of a batch that the kept table does not have yet."""
    spark = batch.sparkSession
    try:
        known = spark.read.parquet(path).select(key)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        batch = batch.join(known, key, "left_anti")
    batch.dropDuplicates([key]).write.mode("append").parquet(path)
