"""Pairing documents with records, and merging extracted values into them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import text as T
from ..schemas import CURRENCY, FIELDS, FINANCIALS, INCOME_STATEMENT, UNIT


# The source stamp and the messages of a backfill.
BACKFILL_SOURCE = "smart_processor_enhanced"
BACKFILLED = "成功回填財務數據"
NO_ORIGINAL = "找不到原始檔案: "


def paired(documents: DataFrame, records: DataFrame, key: str = "stem") -> DataFrame:
    return documents.join(records, key, "inner")


def unprocessed(documents: DataFrame, done: DataFrame, key: str = "stem") -> DataFrame:
    return documents.join(done.select(key), key, "left_anti")


def pair_status(enhanced: DataFrame, originals: DataFrame, key: str = "stem") -> DataFrame:
    """Each enhanced record with ready or missing_original."""
    there = originals.select(key).distinct().withColumn("_there", F.lit(True))
    return enhanced.join(there, key, "left").withColumn("status", F.when(F.col("_there"), "ready").otherwise("missing_original")).drop("_there")


def processed_counts(documents: DataFrame, done: DataFrame) -> DataFrame:
    """One row: total, processed, remaining."""
    a, b = documents.agg(F.count("*").alias("total")), done.agg(F.count("*").alias("processed"))
    return a.crossJoin(b).withColumn("remaining", F.col("total") - F.col("processed"))


def named(rows: DataFrame, names: DataFrame, key: str, name: str, prefix: str) -> DataFrame:
    """Adds ``name`` from a dimension table, or ``prefix`` + key."""
    return rows.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.concat(F.lit(prefix), F.col(key).cast("string"))))


def present_wins(*maps: Column) -> Column:
    """Union of maps in which a key that is present later wins, even with a null."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    filled = [F.coalesce(m, empty) for m in maps]
    return functools.reduce(lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.when(F.map_contains_key(b, k), y).otherwise(x)), filled)


def backfilled(records: DataFrame, extracted: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``records`` with each field's extracted value, else its own."""
    new = extracted.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = records.join(new, key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f"_new_{f}"), F.col(f)) for f in fields}).drop(*[f"_new_{f}" for f in fields])


def wide(found: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row a document from (doc_id, field, value) rows, in one aggregate."""
    return found.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def changes(before: DataFrame, after: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, old, new) where the two differ or one has no value: a true before and after."""
    old = before.select(key, *[F.col(f).cast("double").alias(f"_old_{f}") for f in fields])
    new = after.select(key, *[F.col(f).cast("double").alias(f"_new_{f}") for f in fields])
    both = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_old_{f}").alias("old"), F.col(f"_new_{f}").alias("new")) for f in fields])
    differ = F.filter(both, lambda v: ~v["old"].eqNullSafe(v["new"]))
    return old.join(new, key).select(key, F.explode(differ).alias("v")).select(key, "v.*")


def complete(records: DataFrame, name: str = "file_name") -> DataFrame:
    """Adds period, currency, unit and financial_data (financials, then income statement, then the constants)."""
    of = lambda s, fs: F.map_from_arrays(F.array(*map(F.lit, fs)), F.array(*[F.col(f"{s}.{f}").cast("string") for f in fs]))
    constants = F.create_map(F.lit("currency"), F.lit(CURRENCY), F.lit("unit"), F.lit(UNIT))
    data = present_wins(of("financials", FINANCIALS), of("income_statement", INCOME_STATEMENT), constants)
    period = F.when(F.col("report_year").isNotNull(), P.period(F.col("report_year"), F.col("report_season"))).otherwise(P.calendar_period(F.col(name)))
    return records.withColumns({"report_period": period, "currency": F.lit(CURRENCY), "unit": F.lit(UNIT), "financial_data": data})


def non_null_count(data: Column) -> Column:
    """Values of a map that are not null, constants included."""
    return F.size(F.map_filter(data, lambda k, v: v.isNotNull())).cast("long")


def written_values(data: Column, fields: tuple[str, ...] = FIELDS) -> list[Column]:
    """The fields' numbers of a merged map; wrapped values are unwrapped."""
    return [T.number(T.unwrap(F.try_element_at(data, F.lit(f)))).alias(f) for f in fields]


def enhanced_metadata(metadata: Column, confidence: Column, as_of: str, version: str = "smart_v2.1") -> Column:
    """A metadata map with time (given, not taken from a clock), version and confidence."""
    return present_wins(metadata, F.create_map(F.lit("enhanced_at"), F.lit(as_of), F.lit("processor_version"), F.lit(version), F.lit("confidence"), confidence))


def record_backfill(originals: DataFrame, enhanced: DataFrame, as_of: str, key: str = "stem") -> DataFrame:
    """Originals (in map form) with the values of their enhanced records: financial_data, then income_statement,
    then financials, then the maps of ``page_data``, a key that is present later winning even with a null; a null
    keeps the old value.  Only the eleven fields are written; metadata gets last_backfill (``as_of``), its source
    and the number of values.  ``before_financials`` and ``before_income_statement`` keep the old sections."""
    merged = present_wins("financial_data", "income_statement", "financials", F.aggregate(F.coalesce("page_data", F.array().cast("array<map<string,string>>")), F.create_map().cast("map<string,string>"), lambda a, m: present_wins(a, m)))
    new = enhanced.select(key, merged.alias("_new"))
    rows = originals.join(new, key)

    def section(name: str, fields: tuple[str, ...]) -> Column:
        written = F.map_filter(F.transform_values("_new", lambda k, v: T.unwrap(v)), lambda k, v: v.isNotNull() & k.isin(*fields))
        return present_wins(name, written)

    stamps = F.create_map(F.lit("last_backfill"), F.lit(as_of), F.lit("backfill_source"), F.lit(BACKFILL_SOURCE), F.lit("enhanced_fields_count"), non_null_count(F.col("_new")).cast("string"))
    return rows.withColumns({
        "before_financials": F.col("financials"), "before_income_statement": F.col("income_statement"),
        "financials": section("financials", FINANCIALS), "income_statement": section("income_statement", INCOME_STATEMENT), "metadata": present_wins("metadata", stamps),
    }).drop("_new")


def backfill_results(enhanced: DataFrame, originals: DataFrame, key: str = "stem") -> DataFrame:
    """(enhanced_file, original_file, success, message), one row for each enhanced record."""
    rows = pair_status(enhanced.select(key), originals, key)
    ready, original = F.col("status") == "ready", F.concat(F.col(key), F.lit(".json"))
    message = F.when(ready, F.lit(BACKFILLED)).otherwise(F.concat(F.lit(NO_ORIGINAL), original))
    return rows.select(F.concat(F.col(key), F.lit("_enhanced.json")).alias("enhanced_file"), original.alias("original_file"), ready.alias("success"), message.alias("message"))


def batch_result(rows: DataFrame, success: str = "success") -> DataFrame:
    """One row: total, succeeded, and whether any did."""
    return rows.agg(F.count("*").alias("total"), F.count_if(success).alias("succeeded"), F.coalesce(F.bool_or(success), F.lit(False)).alias("any_success"))
