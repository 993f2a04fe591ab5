"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled (by the MD5 of their doc_id and a seed)
and queue up one after another, as often as the source may be repeated.  A copy
finishes at virtual time (source words up to and with it) / (source target).
All copies, in order of virtual time, are taken up to the total budget, so that
all sources reach their targets at about the same virtual time, 1.  Only where a source
waits for a document longer than its target do the others run on, and then no further than
virtual time LATEST, twice their targets; the budget may stay unspent there.

Targets: sources in code-point order, null last, take the weights in turn and
share the budget by weight; a target stops at ``repeats`` times its source's
words and the excess is shared again, by weight, among the others.

Running sums are two-level: a source's documents are dealt by hash into buckets
of about ROWS rows, the bucket totals are summed, and each bucket adds its base;
so a source that holds a third of all rows is spread like the rest.  The cut is
found the same way over ranges of virtual time; only the place of the cut, one
row, is broadcast.

Null or empty text has no words and takes none.  Rows that are alike in all
columns are taken as single rows.  An empty table stays empty.  Columns of any
other name pass through ``mix`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exclusive_offsets, saved, small, table, words_of

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Rows of a bucket in the running sums.
ROWS = 4096
#: Copies that finish later than this virtual time are not taken, even within the budget.
LATEST = 2.0


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """(source, source_size, source_rows, rank, budget, target): one row a source.

    The target is min(repeats * size, level * weight); the level at which the targets
    meet the budget is the greatest of (budget - capped) / (weights not capped) over
    sources capped in the order in which they fill up."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    everywhere = Window.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * repeats)
    ranked = ranked.withColumn("all_weight", F.sum("weight").over(everywhere)).withColumn("budget", F.sum("source_size").over(everywhere) * F.lit(share))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(filled), F.lit(0))
    ranked = ranked.withColumn("level", (F.col("budget") - before("cap")) / (F.col("all_weight") - before("weight")))
    level = F.max("level").over(everywhere)
    return ranked.select("source", "source_size", "source_rows", "rank", "budget", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def queued(sized: DataFrame, goals: DataFrame, n_sources: int, seed: str) -> DataFrame:
    """``sized`` with its source's figures, the shuffle key and ``served``: the source's
    words up to and with this row, in the order of the keys."""
    rows = sized.alias("d").join(small(goals, n_sources).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "source_rows", "rank", "budget", "target")
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    buckets = F.ceil(F.col("source_rows") / ROWS)
    rows = rows.withColumn("bucket", F.floor(number * buckets / F.lit(float(1 << 32))))
    bases = exclusive_offsets(rows.groupBy("rank", "bucket").agg(F.sum("size").alias("total")), "bucket", "total", ("rank",))
    upto = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("served", F.sum("size").over(upto))
    return rows.join(bases.select("rank", "bucket", "base"), ["rank", "bucket"]).withColumn("served", F.col("served") + F.col("base")).drop("base", "bucket")


def finish(copy: int) -> Column:
    """Virtual finish time of the n-th copy (0: the first)."""
    return F.when(F.col("size") > 0, (F.col("source_size") * copy + F.col("served")) / F.col("target"))


def cut(rows: DataFrame, repeats: int, n_rows: int) -> DataFrame:
    """One row, or none: the virtual time and key of the last copy within the budget."""
    copies = rows.select("budget", "size", "key", F.explode(F.array(*[finish(e) for e in range(repeats)])).alias("time")).filter(F.col("time") <= LATEST)
    copies = copies.withColumn("slot", F.floor(F.col("time") * max(1, n_rows // ROWS)))
    bases = exclusive_offsets(copies.groupBy("slot").agg(F.sum("size").alias("total")), "slot", "total")
    upto = Window.partitionBy("slot").orderBy("time", "key").rowsBetween(Window.unboundedPreceding, 0)
    copies = copies.withColumn("taken", F.sum("size").over(upto)).join(bases.select("slot", "base"), "slot")
    return copies.filter(F.col("base") + F.col("taken") <= F.col("budget")).agg(F.max(F.struct("time", "key")).alias("last"))


def decisions(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """One narrow row for each row of ``docs``: doc_id, tie (a hash of the whole row),
    source, size, source_size, target, copies (how often it is taken) and its first
    copy's virtual finish time."""
    sized = docs.select(F.col("doc_id").cast("long"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("tie"), F.col("source").cast("string"), words_of(F.col("text").cast("string")).alias("size"))
    sized = saved(sized)
    goals = saved(targets(sized, weights, repeats, share))
    rows = saved(queued(sized, goals, goals.count(), seed))
    last = cut(rows, repeats, rows.count())
    here = lambda e: F.struct(finish(e).alias("time"), F.col("key"))
    copies = sum((F.coalesce((here(e) <= F.col("last")) & finish(e).isNotNull(), F.lit(False)).cast("long") for e in range(repeats)), F.lit(0).cast("long"))
    return rows.crossJoin(F.broadcast(last)).select("doc_id", "tie", "source", "size", "source_size", "target", copies.alias("copies"), finish(0).alias("finish"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, with the same columns."""
    chosen = decisions(docs, **how).groupBy("doc_id", "tie").agg(F.sum("copies").alias("copies"), F.count("*").alias("alike")).filter("copies > 0")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("tie"))
    same = Window.partitionBy("tie", "doc_id").orderBy("tie")
    joined = rows.alias("r").join(chosen.alias("c"), (F.col("r.tie") == F.col("c.tie")) & F.col("r.doc_id").eqNullSafe(F.col("c.doc_id"))).select("row", "r.doc_id", "r.tie", "copies", "alike")
    share = F.floor(F.col("copies") / F.col("alike")) + (F.row_number().over(same) <= F.col("copies") % F.col("alike")).cast("long")
    return joined.withColumn("n", share).select("row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("row.*")


def op5_weighted_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their source's target and the words that the mix takes of each."""
    chosen = decisions(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || doc_id) AS key FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sources),
weighed AS (
  SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS BIGINT) AS weight, source_size * 3 AS cap FROM ranked),
levels AS (
  SELECT *, sum(source_size) OVER () * 1.0::DOUBLE AS budget,
    (sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT *, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
queued AS (
  SELECT d.*, s.source_size, s.budget, s.target, CAST(sum(size) OVER (PARTITION BY s.rank ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS served
  FROM sized d JOIN goals s ON d.source IS NOT DISTINCT FROM s.source),
copies AS (
  SELECT doc_id, size, budget, key, (source_size * e + served)::DOUBLE / target AS time FROM queued, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
taken AS (
  SELECT doc_id, size, budget, sum(size) OVER (ORDER BY time, key ROWS UNBOUNDED PRECEDING) AS upto FROM copies WHERE time <= 2),
counted AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM taken WHERE upto <= budget GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM queued LEFT JOIN counted USING (doc_id)
"""
