"""What the operators share: reading tables, cutting lineage, prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a block in the two-level prefix sums.
BLOCK = 1024
#: A table of one short row for each partition is broadcast up to this many rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary
    one of our own where that is unset and the master is this machine alone, as in tests."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{_machine_local_dir()}"
    return where.rstrip("/")


@functools.lru_cache(maxsize=1)
def _machine_local_dir() -> str:
    return tempfile.mkdtemp(prefix="quarterlight-")


def _delete(jvm, settings, path: str) -> None:
    with contextlib.suppress(Exception):  # what stays behind is only disk
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(settings).delete(where, True)


@functools.lru_cache(maxsize=8)
def _session_dir(shared: str, context) -> str:
    path = f"{shared}/quarterlight-{uuid.uuid4().hex}"
    atexit.register(_delete, context._jvm, context._jsc.hadoopConfiguration(), path)
    return path


def own_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes when the driver's Python ends."""
    return f"{_session_dir(shared_dir(spark), spark.sparkContext)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept as Parquet in the shared folder; its lineage ends
    there.  ``removed`` deletes it; else it stays until the driver's Python ends."""
    path = own_dir(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def removed(*frames: DataFrame) -> None:
    """Deletes what ``saved`` wrote; no later plan may read these frames."""
    for f in frames:
        context = f.sparkSession.sparkContext
        _delete(context._jvm, context._jsc.hadoopConfiguration(), f.saved_at)


def exclusive_offsets(totals: DataFrame, order: str, value: str, within: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``base``: the sum of ``value`` over the rows of ``within`` with a lower ``order``
    (a non-negative whole number, one row each), and the like as v_base for each v of ``more``.  Blocks
    of BLOCK numbers are summed first, so no task sees more than BLOCK rows, or one row for each block."""
    values = (value, *more)
    keyed = totals.withColumn("_block", F.floor(F.col(order) / BLOCK))
    blocks = keyed.groupBy(*within, "_block").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    before = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*within, "_block", *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values])
    inside = Window.partitionBy(*within, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumns({f"_inside_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    on = functools.reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*within, "_block")])
    joined = keyed.alias("a").join(blocks.alias("b"), on)
    return joined.select(*[F.col(f"a.{c}") for c in totals.columns], *[(F.col(f"_before_{v}") + F.col(f"_inside_{v}")).alias("base" if v == value else f"{v}_base") for v in values])


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where ``rows`` (known, not guessed) is small; else none."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def words_of(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
