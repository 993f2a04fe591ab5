"""The corpus pipeline over ``documents``: each stage works on all that its
predecessor kept and, but for the last, returns the columns of documents.

1. quality rules: documents rejected by the base rule or the isolation forest go
2. toxicity: documents that the string-kernel machine rejects go
3. near-duplicates: one document of each class stays
4. mixing: documents are repeated or left out to meet the sources' targets
5. packing: sequences of 4096 ids; one row for each piece

A stage is (spark, docs, sf_dir) -> DataFrame.  ``run`` writes each stage's result
as Parquet in the shared folder and reads it for the next.  Null or empty texts
fail the base rule; an empty table gives an empty result.

Stages that hand texts to Python have the session do so in batches of BATCH_BYTES, for Spark's own
limit (10000 rows or 64 MB) takes hundreds of MB of an executor beside its heap.  A limit that the
user has set holds; ``run`` takes its own back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight.llm import mixing, near_dedup, packing, quality, toxicity
from quarterlight.llm.common import own_dir, table

#: Rows that go to a Python worker at a time hold about this many bytes.
BATCH_BYTES = 6 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def toxicity_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return near_dedup.distinct(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_rules),
    ("near_dedup", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Isolation forest, kernel machine and tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    folder, limit = own_dir(spark, "pipeline"), spark.conf.get(BATCH_SETTING, None)
    try:
        for name, stage in STAGES:
            path = f"{folder}/{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        if limit is None:
            spark.conf.unset(BATCH_SETTING)
    return docs
