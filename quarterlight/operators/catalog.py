"""The report catalog and batch requests."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import periods as P


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the one greatest by ``order``."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def upserted(index: DataFrame, new: DataFrame, key: str = "id", order: str = "crawled_at") -> DataFrame:
    """The catalog with ``new`` in place of rows of the same key; seasons are normalised."""
    rows = index.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(rows, [key], ["_new", order]).drop("_new")


def searched(index: DataFrame, stock_code: str | None = None, company_name: str | None = None, year: int | None = None, season: str | None = None) -> DataFrame:
    """All given predicates hold; an empty one is none.  Names match inside, whatever their case."""
    tests: list[Column] = []
    if stock_code:
        tests.append(F.col("stock_code") == stock_code)
    if company_name:
        tests.append(F.contains(F.lower("company_name"), F.lit(company_name.lower())))
    if year:
        tests.append(F.col("year") == year)
    if season:
        tests.append(P.normalize_season(F.col("season")) == P.normalize_season(F.lit(str(season))))
    return index.filter(functools.reduce(Column.__and__, tests)) if tests else index


#: Codes of four digits, which a bitmap holds.
CODES = 10_000


def stats(index: DataFrame, code: str = "stock_code", updated: str | None = None) -> DataFrame:
    """One row: reports, distinct codes and their sorted list; with ``updated``, the latest of that column.

    Codes of four digits are one bitmap of fixed size, put together before the shuffle and read off at the end; any other
    codes are made distinct by a shuffle of their own, so that no task gathers a set."""
    last = [F.max(updated).alias("last_updated")] if updated else []
    four = F.coalesce(F.col(code).cast("string").rlike("^[0-9]{4}$"), F.lit(False))
    number = F.when(four, F.col(code).cast("string").try_cast("int"))
    one = index.agg(F.count("*").alias("total_reports"), F.bitmap_construct_agg(F.bitmap_bit_position(number + 1)).alias("_bits"), *last)
    octet = lambda i: F.conv(F.hex(F.substring("_bits", F.floor(i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.filter(F.sequence(F.lit(0), F.lit(CODES - 1)), lambda i: F.getbit(octet(i), (i % 8).cast("int")) == 1)
    listed = F.transform(there, lambda i: F.lpad(i.cast("string"), 4, "0"))
    others = index.filter(~four & F.col(code).isNotNull()).select(F.col(code).cast("string").alias("c")).distinct().agg(F.collect_list("c").alias("_others"))
    both = one.crossJoin(F.broadcast(others)).withColumn("codes", F.array_sort(F.concat(listed, "_others")))
    return both.select("total_reports", F.size("codes").cast("long").alias("n_codes"), "codes", *(["last_updated"] if updated else []))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters, whatever the case of letters."""
    lower = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(lower) - 2, F.lit(1))), lambda i: F.substring(lower, i, F.lit(3))))


def name_index(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(trigram, key): the posting lists of names, to be kept as a table, best partitioned or sorted by trigram."""
    return rows.filter(F.length(name) >= 3).select(F.col(key), F.explode(trigrams(F.col(name))).alias("trigram"))


def found_by_index(rows: DataFrame, postings: DataFrame, part: str, key: str, name: str) -> DataFrame:
    """The rows with ``part`` in their name, whatever the case: those that have all its trigrams are looked up and
    tested; a part of less than three characters is searched for in all rows."""
    holds = F.contains(F.lower(name), F.lit(part.lower()))
    if len(part.lower()) < 3:
        return rows.filter(holds)
    wanted = sorted({part.lower()[i : i + 3] for i in range(len(part.lower()) - 2)})
    keys = postings.filter(F.col("trigram").isin(*wanted)).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= len(wanted))
    return rows.join(keys.select(key), key, "left_semi").filter(holds)


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def requests_checked(queries: DataFrame) -> DataFrame:
    """Adds is_valid: four fields there, four-digit code, year from 2020 to 2030, season 1 to 4; and the file name."""
    there = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in ("stock_code", "company_name", "year", "season")])
    ok = there & P.valid_stock_code(F.col("stock_code")) & P.valid_season(F.col("season")) & F.coalesce(F.col("year").between(2020, 2030), F.lit(False))
    return queries.withColumn("season", P.normalize_season(F.col("season"))).withColumn("is_valid", ok).withColumn("pdf_file", F.when(F.col("is_valid"), P.file_name(F.col("year"), F.col("season"), F.col("stock_code"))))


def newest(files: DataFrame) -> DataFrame:
    """One row: number of files and the one modified last."""
    return files.agg(F.count("*").alias("n"), F.max_by("name", F.struct("modified", "name")).alias("newest"))


def by_crawl(index: DataFrame) -> DataFrame:
    """The catalog, crawled last first; times compare as text."""
    return index.orderBy(F.col("crawled_at").desc_nulls_last(), "id")


def files_named(files: DataFrame, part: str, name: str = "name") -> DataFrame:
    """Files with ``part`` in their name, whatever the case of letters."""
    return files.filter(F.contains(F.lower(name), F.lit(part.lower())))


def shown(rows: DataFrame, order: list, most: int = 10) -> DataFrame:
    """The first ``most`` rows by ``order``, each with ``n_more``, the number of rows that are left out."""
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(rows.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("n_more"))))


def remaining_seconds(elapsed: Column, current: Column, total: Column) -> Column:
    """Elapsed time carried on to the total, less what has passed; null before the first item."""
    return F.when(current > 0, elapsed * (total.cast("double") / current) - elapsed)
