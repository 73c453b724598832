"""Streaming forms of counts and sessions over event files; an extension, held against the batch results in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def weekly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per code and week; state goes when the watermark passes a window."""
    return events.withWatermark("start", late).groupBy(F.window("start", "7 days"), "code").count().select(F.col("window.start").alias("week"), "code", F.col("count").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a patient's events, a surrogate of visits."""
    return events.withWatermark("start", late).groupBy(F.session_window("start", gap), "pid").agg(F.count("*").alias("n")).select("pid", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
