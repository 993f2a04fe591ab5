"""Processing tasks: an append-only event log, folded into states, and reports on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import STATUSES, TASK_COLUMNS

PATHS = ("pdf_path", "json_path", "processed_path", "enhanced_path")
RETRIES = 3
# Recommendations.
MANY_FAILURES = "失敗率較高，建議檢查PDF品質和OCR設定"
SLOW = "處理時間較長，建議啟用並行處理或GPU加速"
OCR_ERRORS = "OCR相關錯誤較多，建議調整信心閾值或切換OCR引擎"
NETWORK_ERRORS = "網路相關錯誤較多，建議增加重試次數或檢查網路連線"


@dataclass(frozen=True)
class Log:
    """The columns of an event log.  ``seq`` tells a task's events apart and orders them; an event that is
    delivered again is the same row."""

    key: str = "id"
    seq: str = "seq"
    status: str = "status"
    message: str = "error_message"
    seconds: str = "processing_time"
    kind: str = "kind"

    def texts(self, events: DataFrame) -> dict[str, tuple[str, Column]]:
        """Each text that a state keeps the last of: its column, and which events give one."""
        said = F.coalesce(F.col(self.message), F.lit("")) != ""
        return {"status": (self.status, F.col(self.kind) == "status"), "error_message": (self.message, said), **{c: (c, F.col(c).isNotNull()) for c in PATHS if c in events.columns}}

    def failure(self) -> Column:
        return (F.col(self.status) == "failed") & (F.coalesce(F.col(self.message), F.lit("")) != "") & (F.col(self.kind) == "status") & F.col(self.seq).isNotNull()


def partial(events: DataFrame, log: Log = Log()) -> tuple[DataFrame, DataFrame]:
    """(states, failures) of some events, in any order: what ``merged`` puts together and ``finished`` reads.

    A state has the place of the task's last create, and each last value with its place.  Places, numbers
    all, are aggregated by hash before the shuffle; the few events at these places are then looked up for
    their texts.  Failures are the tasks' failed events, (key, seq), each its own row, so a task with very many is
    no hot key."""
    events = events.filter(F.col(log.key).isNotNull())
    texts = log.texts(events)
    timed = F.when(F.coalesce(F.col(log.seconds), F.lit(0.0)) != 0, F.col(log.seq))
    last = [F.max(F.when(test, F.col(log.seq))).alias(f"{name}_at") for name, (_, test) in texts.items()]
    places = events.groupBy(F.col(log.key).alias("key")).agg(F.max(F.when(F.col(log.kind) == "create", F.col(log.seq))).alias("created"), F.max_by(log.seconds, timed).alias("processing_time"), F.max(timed).alias("processing_time_at"), *last)
    ats = [f"{name}_at" for name in texts]
    wanted = places.select("*", F.explode_outer(F.array_distinct(F.array_compact(F.array(*ats)))).alias("_seq"))
    rows = events.select(F.col(log.key).alias("_key"), F.col(log.seq).alias("_at"), F.struct(F.col(log.seq).alias("at"), *[F.col(c).alias(name) for name, (c, _) in texts.items()]).alias("row"))
    found = wanted.join(rows, (F.col("key") == F.col("_key")) & (F.col("_seq") == F.col("_at")), "left")
    kept = ["created", "processing_time", "processing_time_at", *ats]
    whole = found.groupBy("key").agg(*[F.max(c).alias(c) for c in kept], F.collect_set("row").alias("rows"))
    value = lambda name: F.get(F.filter("rows", lambda r: r["at"] == F.col(f"{name}_at")), F.lit(0))[name].alias(name)
    states = whole.select("key", "created", "processing_time", "processing_time_at", *[c for name in texts for c in (value(name), F.col(f"{name}_at"))])
    return states, events.filter(log.failure()).select(F.col(log.key).alias("key"), F.col(log.seq).alias("seq")).distinct()


def merged(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """States and failures of the events of both, which may overlap; in whatever order parts are merged, the
    result is the same.  The log isn't read again.  Failures before a task's last create go."""
    (old, before), (new, after) = a, b
    names = [c for c in old.columns if c not in ("key", "created") and not c.endswith("_at")]
    both = old.select("key", *[F.col(c).alias(f"old_{c}") for c in old.columns if c != "key"]).join(new, "key", "full")
    newer = lambda c: F.col(f"{c}_at").isNotNull() & (F.col(f"old_{c}_at").isNull() | (F.col(f"{c}_at") >= F.col(f"old_{c}_at")))
    values = [x for c in names for x in (F.when(newer(c), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c), F.greatest(f"old_{c}_at", f"{c}_at").alias(f"{c}_at"))]
    states = both.select("key", F.greatest("old_created", "created").alias("created"), *values)
    failures = before.union(after).distinct().join(states.select("key", "created"), "key").filter(F.col("created").isNull() | (F.col("seq") >= F.col("created")))
    return states, failures.select("key", "seq")


def finished(states: DataFrame, failures: DataFrame, log: Log = Log()) -> DataFrame:
    """One row a task.  Only what follows the last create counts; tasks never created are left out.  The last
    status holds; a message stays until a filled one follows; a failure with a message is a
    retry; a time of 0 or null is no time; each path is the last one given."""
    tasks = states.filter(F.col("created").isNotNull())
    # Counted for each create that a failure may follow, and before the shuffle.
    retries = failures.join(tasks.select("key", "created"), "key").filter(F.col("seq") >= F.col("created")).groupBy("key").agg(F.count("*").alias("retries"))
    holds = lambda c: F.when(F.col(f"{c}_at") >= F.col("created"), F.col(c))
    paths = [holds(c).alias(c) for c in PATHS if c in states.columns]
    out = tasks.join(retries, "key", "left")
    return out.select(F.col("key").alias(log.key), F.coalesce(holds("status"), F.lit("pending")).alias("status"), holds("error_message").alias("error_message"), F.coalesce("retries", F.lit(0)).alias("retry_count"), holds("processing_time").alias("processing_time"), *paths)


def folded(events: DataFrame, log: Log = Log()) -> DataFrame:
    """One row a task from its events (kind create, status or paths), in the order of ``seq``; see ``finished``."""
    return finished(*partial(events, log), log)


def known_statuses(tasks: DataFrame, status: str = "status") -> DataFrame:
    """``tasks``; a row with a status that is none of the eight stops the query."""
    return tasks.withColumn(status, F.when(F.col(status).isin(*STATUSES), F.col(status)).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(F.col(status), F.lit("null")))).cast("string")))


def by_status(tasks: DataFrame, status: str, order: str = "created_at") -> DataFrame:
    return tasks.filter(F.col("status") == status).orderBy(order)


def task(tasks: DataFrame, task_id: str) -> DataFrame:
    return tasks.filter(F.col("id") == task_id).limit(1)


def ordered(tasks: DataFrame, by: str = "created_at") -> DataFrame:
    """All tasks by one of the sixteen columns."""
    if by not in TASK_COLUMNS:
        raise ValueError(f"no such column: {by}")
    return tasks.orderBy(by)


def retryable(tasks: DataFrame, most: int = RETRIES) -> DataFrame:
    return tasks.filter((F.col("status") == "failed") & (F.col("retry_count") < most))


def time_statistics(tasks: DataFrame, seconds: str = "processing_time") -> DataFrame:
    """One row: mean, least and greatest time; 0 where there is none.  Summed as decimals, so that order plays no part."""
    exact = F.col(seconds).cast("decimal(28,6)")
    mean = F.try_divide(F.sum(exact).cast("double"), F.count(exact).cast("double"))
    return tasks.agg(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for c, n in ((mean, "average"), (F.min(exact), "minimum"), (F.max(exact), "maximum"))])


def top_errors(tasks: DataFrame, message: str = "error_message", most: int = 10) -> DataFrame:
    """The most frequent messages; equal counts by message."""
    return tasks.filter(F.col(message).isNotNull()).groupBy(message).agg(F.count("*").alias("n")).orderBy(F.desc("n"), message).limit(most)


def progress(tasks: DataFrame, done: str = "enhanced", pending: str = "pending", status: str = "status", seconds: str = "processing_time", retries: str = "retry_count") -> DataFrame:
    """One row: totals, completion in percent (2 decimals), minutes to go (1 decimal), failed and retryable tasks."""
    exact = F.col(seconds).cast("decimal(28,6)")
    one = tasks.agg(
        F.count("*").alias("total"), F.count_if(F.col(status) == done).alias("completed"), F.count_if(F.col(status) == pending).alias("pending"), F.count_if(F.col(status) == "failed").alias("failed"),
        F.count_if((F.col(status) == "failed") & (F.col(retries) < RETRIES)).alias("retryable"), F.sum(exact).alias("_sum"), F.count(exact).alias("_n"),
    )
    rate = F.coalesce(F.round(F.try_divide(F.col("completed").cast("decimal(18,0)") * 100, F.col("total")), 2), F.lit(0)).cast("double")
    mean = F.coalesce(F.try_divide(F.col("_sum").cast("double"), F.col("_n").cast("double")), F.lit(0.0))
    return one.withColumns({"completion": rate, "average_seconds": mean}).withColumn("eta_minutes", F.round(F.col("average_seconds") * F.col("pending") / 60, 1)).drop("_sum", "_n")


def recommendations(report: DataFrame, errors: Column) -> DataFrame:
    """Adds recommendations to ``progress`` rows; ``errors`` is an array of the top messages, each of which may add a line."""
    lines = F.transform(errors, lambda e: F.when(F.contains(e, F.lit("OCR")) | F.contains(e, F.lit("文字識別")), OCR_ERRORS).when(F.contains(e, F.lit("網路")) | F.contains(e, F.lit("下載")), NETWORK_ERRORS))
    own = F.array(F.when(F.try_divide(F.col("failed").cast("double"), F.col("total")) > 0.2, F.lit(MANY_FAILURES)), F.when(F.col("average_seconds") > 300, F.lit(SLOW)))
    return report.withColumn("recommendations", F.array_compact(F.concat(own, lines)))
