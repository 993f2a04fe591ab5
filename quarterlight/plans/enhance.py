"""Whole runs as one lazy plan: pages and tables in, enhanced records and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import classify, extract, merge, tracking, validate
from ..schemas import FIELDS
from ..sources import readers

TOTALS = ("total", "valid", "with_warnings", "with_errors", "scores")


def extracted(pages: DataFrame, tables: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, doc_type, confidence, note, field, value): the label cascade and tables where they find
    anything, else the line cascade.  A document without values, as a scanned one is, has one row
    without a field.  Both cascades work page by page: texts stay where they are read, hits and one narrow
    row for each page move.  ``settings`` has the pages that tell the type, and the length below which lines are not read."""
    types = classify.document_types(pages, first=settings.sampled_pages)
    labelled = extract.combined(extract.by_labelled_page(pages), extract.by_table(tables)).withColumn("way", F.lit(0))
    lines = extract.by_page(pages, extract.line_keywords(), settings.text_gate).select("doc_id", "field", "value", F.lit(1).alias("way"))
    both = labelled.unionByName(lines)
    # A document has at most one value a field and way, so its list is short.
    listed = both.groupBy("doc_id").agg(F.collect_list(F.struct("way", "field", "value")).alias("found"))
    way = lambda k: F.filter("found", lambda v: v["way"] == k)
    listed = listed.select("doc_id", F.size(way(0)).alias("n_combined"), F.size(way(1)).alias("n_lines"), F.when(F.size(way(0)) > 0, way(0)).otherwise(way(1)).alias("found"))
    kinds = types.join(listed, "doc_id", "left").withColumns({"n_combined": F.coalesce("n_combined", F.lit(0)), "n_lines": F.coalesce("n_lines", F.lit(0))})
    kinds = kinds.withColumn("confidence", classify.strategy(F.col("doc_type"), F.col("n_combined"), F.col("meaningful_chars") > 0))
    kinds = kinds.withColumn("note", classify.note(F.col("doc_type"), F.col("n_combined"), F.col("n_lines"), F.col("meaningful_chars") > 0))
    found = F.when(F.col("doc_type") != "scanned", F.col("found"))
    return kinds.select("doc_id", "doc_type", "confidence", "note", F.explode_outer(found).alias("v")).select("doc_id", "doc_type", "confidence", "note", "v.field", "v.value")


def recognised(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, field, value, confidence, source) of recognised words, page by page: those that are sure enough, as lines."""
    pages = classify.recognised_text(words, settings.ocr_confidence)
    return extract.with_source(extract.by_page(pages, extract.line_keywords(), settings.ocr_gate), 0.7, "ocr")


def work_left(tasks: DataFrame, files: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(failed tasks to be tried again, files large enough to be read)."""
    return tracking.retryable(tasks, settings.max_retries), readers.acceptable_pdf(files, settings.min_download_bytes)


def stamped(records: DataFrame, found: DataFrame, as_of: str, key: str = "doc_id") -> DataFrame:
    """Records (in map form) of documents that were looked at, with time, version and confidence in their metadata."""
    confidence = found.groupBy(F.col("doc_id").alias(key)).agg(F.max("confidence").alias("_confidence"))
    return records.join(confidence, key).withColumn("metadata", merge.enhanced_metadata(F.col("metadata"), F.col("_confidence"), as_of)).drop("_confidence")


def backfill(records: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flat records (one column a field) with the values found for them."""
    values = merge.wide(found.filter(F.col("field").isin(*FIELDS))).withColumnRenamed("doc_id", key)
    return merge.backfilled(records, values, key)


def batch_backfill(enhanced: DataFrame, originals: DataFrame, as_of: str, key: str = "stem") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(updated records, one result row for each enhanced record, one row of totals)."""
    results = merge.backfill_results(enhanced, originals, key)
    return merge.record_backfill(originals, enhanced, as_of, key), results, merge.batch_result(results)


def quality_report(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(details, summary, issues) of records in map form."""
    details = validate.validated(records)
    return details, validate.quality_summary(details), validate.common_issues(details)


def save_quality_report(records: DataFrame, folder: str, version: str) -> DataFrame:
    """Writes the report as a new version below ``folder``: the totals are observed while the details are
    written, so the rules run once and the details aren't read again for them; the issues are counted from the
    written messages alone.  Returns the one-row summary."""
    spark, path, seen = records.sparkSession, f"{folder.rstrip('/')}/version={version}", Observation()
    validate.validated(records).observe(seen, *validate.summary_metrics()).write.parquet(f"{path}/details")
    totals = spark.createDataFrame([tuple(seen.get[c] for c in TOTALS)], "total long, valid long, with_warnings long, with_errors long, scores decimal(30,6)")
    validate.summary_of(totals).coalesce(1).write.parquet(f"{path}/summary")
    details = spark.read.parquet(f"{path}/details")
    validate.common_issues(details).write.parquet(f"{path}/issues")
    return spark.read.parquet(f"{path}/summary")
