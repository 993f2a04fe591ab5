"""Writers: parquet is the system of record, JSON an export; nothing is overwritten in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_version(df: DataFrame, folder: str, version: str, partitions: tuple[str, ...] = ("report_year", "report_season")) -> str:
    """Writes a new immutable version beside the old ones, partitioned for pruning; returns its path."""
    path = f"{folder.rstrip('/')}/version={version}"
    df.write.partitionBy(*[p for p in partitions if p in df.columns]).parquet(path)
    return path


def export_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def append_results(df: DataFrame, path: str, run_id: str) -> None:
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
