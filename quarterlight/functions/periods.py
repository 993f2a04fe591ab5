"""Seasons, periods and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mark of an unknown period, the file-name pattern and its months.
UNKNOWN = "未知"
NAME_PATTERN = r"^(\d{4}|\d{2})(\d{2})_(\d{4})_AI1\.pdf"
MONTHS = {"03": "Q1", "06": "Q2", "09": "Q3", "12": "Q4"}


def bare(season: Column) -> Column:
    return F.replace(F.upper(season), F.lit("Q"), F.lit(""))


def normalize_season(season: Column) -> Column:
    """Upper case without Q; 1 to 4 become Q1 to Q4, anything else is left bare."""
    b = bare(season)
    return F.when(b.isin("1", "2", "3", "4"), F.concat(F.lit("Q"), b)).otherwise(b)


def valid_season(season: Column) -> Column:
    return F.coalesce(bare(season).isin("1", "2", "3", "4"), F.lit(False))


def season_number(season: Column) -> Column:
    """Two digits; longer text is kept whole."""
    b = F.replace(season, F.lit("Q"), F.lit(""))
    return F.when(F.length(b) < 2, F.lpad(b, 2, "0")).otherwise(b)


def valid_stock_code(code: Column) -> Column:
    return F.coalesce(code.rlike(r"(?U)^\d{4}\z"), F.lit(False))


def file_name(year: Column, season: Column, code: Column, suffix: str = "pdf") -> Column:
    return F.concat(year.cast("string"), season_number(season), F.lit("_"), code, F.lit(f"_AI1.{suffix}"))


def period(year: Column, season: Column) -> Column:
    """2024Q1, or the year alone."""
    return F.concat(year.cast("string"), F.coalesce(normalize_season(season), F.lit("")))


def task_id(code: Column, year: Column, season: Column) -> Column:
    return F.concat(code, F.lit("_"), year.cast("string"), F.lit("Q"), F.replace(season, F.lit("Q"), F.lit("")))


def index_id(code: Column, year: Column, season: Column) -> Column:
    return F.concat(code, F.lit("_"), period(year, season))


def calendar_period(name: Column) -> Column:
    """From the first run of six digits in a file name, its last two read as a month."""
    run = F.regexp_extract(name, r"(\d{6})", 1)
    month = F.substring(run, 5, 2).try_cast("int")
    quarter = F.when(month <= 3, "Q1").when(month <= 6, "Q2").when(month <= 9, "Q3").otherwise("Q4")
    return F.when(run == "", F.lit(UNKNOWN)).otherwise(F.concat(F.substring(run, 1, 4), quarter))


def parse_name(name: Column) -> Column:
    """struct(year, season, stock_code) of YYYYMM_CODE_AI1.pdf or YYMM_CODE_AI1.pdf; null if it is neither.
    Months 03, 06, 09 and 12 are Q1 to Q4, any other is Q1."""
    year = F.regexp_extract(name, NAME_PATTERN, 1)
    full = F.when(F.length(year) == 2, year.try_cast("int") + 2000).otherwise(year.try_cast("int"))
    month = F.regexp_extract(name, NAME_PATTERN, 2)
    season = F.coalesce(*[F.when(month == m, q) for m, q in MONTHS.items()], F.lit("Q1"))
    return F.when(year != "", F.struct(full.alias("year"), season.alias("season"), F.regexp_extract(name, NAME_PATTERN, 3).alias("stock_code")))
