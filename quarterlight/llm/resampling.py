"""Target-distribution importance resampling over hashed word and word-pair features, native.

A text's features are its runs of 1 and 2 words, each in the bucket of its hash.  A
document's buckets are one array, made by higher-order functions.  The buckets are counted over the corpus and
over the target texts, each task summing before the shuffle, so that only BUCKETS totals a task are
shuffled.  A bucket's gain is the logarithm of its share of the target over that of the corpus, in
thousandths, floored; the gains are one literal array of BUCKETS entries.  A document's weight is the floored mean of
``element_at`` of that literal over its own array: nothing is exploded to score.  With Gumbel noise drawn from
the doc_id added, the highest scores are a sample without replacement by weight.

Ranks: scores are whole numbers in a range that doesn't grow with the corpus, so the rows of each score are
counted, the counts summed from above, and rows ranked within their score only.  The noise spreads even
copies of one text: no score holds more than one row in 2700 of those that differ in doc_id.

Words are runs of ASCII letters and digits and of all characters beyond ASCII; A to Z are lower-cased, other letters stay as they
are.  Null and empty texts have no words, no features and weight 0.  Only documents of MIN_WORDS words are
drawn.  A null doc_id draws as if it were empty and comes last in ties; repeated rows are rows of their own, in
ties by a hash of the text.  A text is held in memory as words, about 80 times its bytes.  Only doc_id and text
are read, so other columns' names don't matter.  An empty corpus gives no rows; an empty target has only zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exclusive_offsets, saved, small, table

BUCKETS = 10_000
MIN_WORDS = 20
#: Drawn of 100 documents; thousandths of the gains.
SHARE = 25
SCALE = 1000
SEED = 7
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def bucket(feature: Column) -> Column:
    return (F.crc32(feature) % BUCKETS).cast("short")


def featured(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep``, n_words and buckets, the array of a text's features' buckets."""
    split = texts.select(*keep, words(F.col("text")).alias("words"))
    n = F.size("words")
    pairs = F.zip_with(F.slice("words", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    return split.select(*keep, n.cast("long").alias("n_words"), F.concat(F.transform("words", bucket), pairs).alias("buckets"))


def totals(features: DataFrame) -> DataFrame:
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> list[int]:
    """The gain of each bucket: BUCKETS numbers, whatever the corpus."""
    spark = corpus.sparkSession
    every = spark.range(BUCKETS).select(F.col("id").alias("bucket"))
    got = every.join(totals(corpus).withColumnRenamed("n", "s"), "bucket", "left").join(totals(target).withColumnRenamed("n", "t"), "bucket", "left")
    rows = got.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).collect()
    sums = {c: sum(r[c] for r in rows) for c in ("s", "t")}
    real = lambda c: F.col(c).cast("double")
    ratio = ((real("t") + 1) * F.lit(float(sums["s"] + BUCKETS))) / ((real("s") + 1) * F.lit(float(sums["t"] + BUCKETS)))
    gain = F.floor(F.lit(float(SCALE)) * F.log(ratio)).alias("gain")
    counted = spark.createDataFrame([tuple(r) for r in rows], "bucket long, s long, t long")
    return [r["gain"] for r in counted.select("bucket", gain).orderBy("bucket").collect()]


def literal(numbers: list[int]) -> Column:
    """One array literal: the text is folded into an array when the query is planned."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


def noise(doc_id: Column) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a digest of the doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(features: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, tie, n_words, n_features, weight and score."""
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(literal(gain), b + 1))
    rows = features.select("doc_id", "tie", "n_words", F.size("buckets").cast("long").alias("n_features"), total.alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("doc_id"))).drop("total")


def drawn(rows: DataFrame, share: int = SHARE, least: int = MIN_WORDS) -> DataFrame:
    """``rows`` with ``rank``, from 1 on for the drawn ones, else null."""
    able = F.col("n_words") >= least
    counts = saved(rows.filter(able).groupBy("score").agg(F.count("*").alias("n")))
    seen = counts.agg(F.sum("n"), F.max("score"), F.count("*")).first()
    if not seen[2]:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    many = seen[0] * share // 100
    above = exclusive_offsets(counts.withColumn("place", F.lit(seen[1]) - F.col("score")), "place", "n").select("score", "base").filter(F.col("base") < many)
    near = rows.join(small(above, seen[2]), "score", "left")
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "tie")
    first = near.filter(able & F.col("base").isNotNull()).withColumn("rank", F.col("base") + F.row_number().over(inside)).withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    rest = near.filter(~(able & F.col("base").isNotNull())).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select(*rows.columns, "rank")


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of ``docs``, after the texts of ``target``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    features = saved(featured(rows, "doc_id", "tie"))
    gain = gains(features, featured(target.select("text")))
    return drawn(saved(scored(features, gain)), share, least).drop("tie")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored after the benchmark's texts, a quarter of the long enough ones drawn."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH octets AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goal AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
parts AS (
  SELECT doc_id, false AS aim, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM docs
  UNION ALL SELECT NULL, true, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) FROM goal),
hexed AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM parts)),
bytes AS (
  SELECT f, list_transform(range(len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b FROM hexed),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) % 256 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket FROM bytes, octets),
found AS (
  SELECT doc_id, aim, bucket FROM parts JOIN hashed USING (f)),
counted AS (
  SELECT bucket, count(*) FILTER (NOT aim) AS s, count(*) FILTER (aim) AS t FROM found GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counted),
weighed AS (
  SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM found JOIN gains USING (bucket) WHERE NOT aim GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM docs LEFT JOIN weighed USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS able FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM ranked
"""
