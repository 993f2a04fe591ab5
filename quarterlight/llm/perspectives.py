"""Chat formatting: multi-party perspective rotation.

For every participant of a dialogue the whole dialogue is rendered once with
that speaker as the assistant; the others appear as named users.  The result
has one row for each segment (participant, turn), with its place in the whole
rendering and the character span that a loss mask covers (the speaker's own
words and end mark; an empty span at ``start`` elsewhere), so that a dialogue of any length is never gathered: the
rendering is the concatenation of its segments in order of ``position``.

    <|system|>\\n{text}<|end|>\\n
    <|user|>{name}\\n{text}<|end|>\\n
    <|assistant|>\\n{text}<|end|>\\n

Places are running sums in two levels, over spans of SPAN turn numbers (turns that are null, or
share a number, share a span and meet in one task), then of SPAN positions.
Marks inside texts and names are broken up ("<|" becomes "< |"), so that no
text can pose as another speaker; line ends in names become spaces.  Null text
is empty, a null speaker is "unknown", null turns come first; turns with equal
numbers are ordered by speaker, then text; equal rows are all kept.  System turns
speak to all and are nobody's perspective: a dialogue of system turns alone, or
an empty table, gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exclusive_offsets, saved, table

SPAN = 256
SYSTEM = "system"
END = "<|end|>\n"


def safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def running(rows: DataFrame, key: tuple[str, ...], order: list[str], values: tuple[str, ...]) -> DataFrame:
    """Adds v_before for each v of ``values``: its sum over the rows of ``key`` before, in order of ``span`` and
    then ``order``.  Two levels: inside the spans, and over the spans that occur, numbered inside each key."""
    spans = rows.groupBy(*key, "span").agg(*[F.sum(v).alias(v) for v in values])
    spans = spans.withColumn("number", F.row_number().over(Window.partitionBy(*key).orderBy("span")) - 1)
    bases = exclusive_offsets(spans, "number", values[0], key, values[1:]).withColumnRenamed("base", f"{values[0]}_base").drop("number", *values)
    inside = Window.partitionBy(*key, "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{v}_upto": F.sum(v).over(inside) - F.col(v) for v in values})
    on = functools.reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, "span")])
    joined = rows.alias("r").join(bases.alias("b"), on)
    return joined.select("r.*", *[(F.col(f"{v}_upto") + F.col(f"{v}_base")).alias(f"{v}_before") for v in values]).drop(*[f"{v}_upto" for v in values])


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, perspective, position, turn, role, name, segment, start, mask_start, mask_end).

    Turns are placed once, as if no participant were the assistant.  In a participant's own rendering each of
    their turns is shorter by the same number of characters, so a place there only needs the
    number of own turns before it; those are counted on rows without texts, and each text is joined once."""
    rows = turns.select(
        F.col(conversation).alias("conv_id"), F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 62))).alias("at"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"), safe(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("body"),
    )
    rows = rows.withColumns({"span": F.floor(F.col("at") / SPAN), "name": F.translate(safe(F.col("speaker")), "\r\n", "  ")})
    head = lambda role, name: F.concat(F.lit("<|"), role, F.lit("|>"), name, F.lit("\n"))
    system = F.col("speaker") == SYSTEM
    plain = F.when(system, head(F.lit("system"), F.lit(""))).otherwise(head(F.lit("user"), F.col("name")))
    own_head = len("<|assistant|>\n")
    rows = rows.withColumns({"one": F.lit(1).cast("long"), "chars": (F.length(plain) + F.length("body") + len(END)).cast("long"), "less": (F.length(plain) - own_head).cast("long")})
    placed = saved(running(rows, ("conv_id",), ["at", "speaker", "body"], ("chars", "one")).withColumnRenamed("one_before", "position").drop("at", "span", "one"))

    # Own turns before each place, of every participant: narrow rows.
    narrow = placed.select("conv_id", "position", "speaker", "less", F.floor(F.col("position") / SPAN).alias("span"))
    people = narrow.filter(~system).groupBy("conv_id", F.col("speaker").alias("perspective")).agg(F.first("less").alias("less_each"))
    views = narrow.alias("n").join(people.alias("p"), F.col("n.conv_id").eqNullSafe(F.col("p.conv_id"))).select("n.conv_id", "position", "span", "perspective", "less_each", (F.col("speaker") == F.col("perspective")).cast("long").alias("own"))
    views = running(views, ("conv_id", "perspective"), ["position"], ("own",))
    out = views.alias("v").join(placed.alias("t"), F.col("v.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("v.position") == F.col("t.position")))

    own = F.col("own") == 1
    role = F.when(system, "system").when(own, "assistant").otherwise("user")
    name = F.when(~system & ~own, F.col("name")).otherwise("")
    start = F.col("chars_before") - F.col("own_before") * F.col("less_each")
    return out.select(
        "v.conv_id", "perspective", "v.position", "turn", role.alias("role"), name.alias("name"), F.concat(head(role, name), F.col("body"), F.lit(END)).alias("segment"), start.alias("start"),
        F.when(own, start + own_head).otherwise(start).alias("mask_start"), F.when(own, start + F.col("chars") - F.col("less_each")).otherwise(start).alias("mask_end"),
    )


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from every role's perspective."""
    return rotate(table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
views AS (
  SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
named AS (SELECT *, CASE WHEN role = 'user' THEN replace(replace(replace(speaker, '<|', '< |'), chr(10), ' '), chr(13), ' ') ELSE '' END AS name FROM views),
heads AS (SELECT *, '<|' || role || '|>' || name || chr(10) AS head FROM named),
segments AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM heads),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER w AS BIGINT) - length(segment) AS start
  FROM segments WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, role, name, segment, start,
  CASE WHEN role = 'assistant' THEN start + length(head) ELSE start END AS mask_start, CASE WHEN role = 'assistant' THEN start + length(segment) ELSE start END AS mask_end
FROM placed
"""
