"""The functions for SQL text: made for a session, as temporary SQL functions without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BARE = "replace(upper(season), 'Q', '')"
#: Name and parameters, type, body.
SCALARS = {
    "bare_season(season STRING)": ("STRING", BARE),
    "normalize_season(season STRING)": ("STRING", f"CASE WHEN {BARE} IN ('1', '2', '3', '4') THEN concat('Q', {BARE}) ELSE {BARE} END"),
    "validate_season(season STRING)": ("BOOLEAN", f"coalesce({BARE} IN ('1', '2', '3', '4'), false)"),
    "validate_stock_code(code STRING)": ("BOOLEAN", r"coalesce(code RLIKE r'(?U)^\d{4}\z', false)"),
    "file_size_label(size BIGINT)": (
        "STRING",
        "CASE WHEN size = 0 THEN '0 B' WHEN size < 0 THEN NULL "
        + " ".join(f"WHEN size < {1024 ** (i + 1)} THEN concat(CAST(CAST(round(CAST(size AS DECIMAL(20, 0)) / CAST({1024**i} AS DECIMAL(12, 0)), 2) AS DOUBLE) AS STRING), ' {unit}')" for i, unit in enumerate(("B", "KB", "MB", "GB")))
        + " END",
    ),
}
SEARCHED = "id STRING, stock_code STRING, company_name STRING, year INT, season STRING"


def register(spark: SparkSession) -> None:
    """normalize_season, validate_season, validate_stock_code and file_size_label for the session's SQL."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")


def register_catalog(spark: SparkSession, index: DataFrame, view: str = "reports") -> None:
    """``index`` as a view, and search_<view>(code, name, year, season), a table function of the rows for which all given
    predicates hold: a null or empty one is none."""
    register(spark)
    names = [c.split()[0] for c in SEARCHED.split(", ")]
    index.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in SEARCHED.split(", ")]).createOrReplaceTempView(view)
    tests = (
        "(coalesce(code, '') = '' OR r.stock_code = code) AND (coalesce(name, '') = '' OR contains(lower(r.company_name), lower(name))) "
        "AND (coalesce(of_year, 0) = 0 OR r.year = of_year) AND (coalesce(of_season, '') = '' OR normalize_season(r.season) = normalize_season(of_season))"
    )
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION search_{view}(code STRING, name STRING, of_year INT, of_season STRING) RETURNS TABLE({SEARCHED}) RETURN SELECT {', '.join(f'r.{c}' for c in names)} FROM {view} r WHERE {tests}")
