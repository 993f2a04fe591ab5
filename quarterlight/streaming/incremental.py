"""Incremental runs over streams; beyond the batch engine's scope, with its code unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog


def page_stream(spark: SparkSession, folder: str, schema: str, files: int = 1000) -> DataFrame:
    """New parquet files of pages as they arrive, so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def status_counts(events: DataFrame, time: str = "ts", status: str = "status", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tasks by status and window, for events at most so late."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), status).agg(F.count("*").alias("n")).select("window.start", status, "n")


def upserting(folder: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends each batch's latest rows under its number; running a batch again replaces its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        catalog.latest(batch, [key], [order]).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return put


def current(spark: SparkSession, folder: str, key: str, order: str) -> DataFrame:
    """The rows that hold now, from all batches."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    return catalog.latest(rows, [key], ["batch", order]).drop("batch")
