"""Hard negatives by distributed radix selection.

Vectors are whole numbers (each component becomes floor(256 * x)) and scores inner products.  For
an anchor and each of its positives, its best rows of the same label, the wanted negatives are the
best rows of other labels in the window RATIO[0] * positive <= 100 * score <= RATIO[1] * positive.

A row's key in a window is how far it is below the window's top.  Each task makes a histogram
of the keys' leading digits for each window; digits behind those that hold the task's own first k
rows can't hold the k-th of all and are left out, so a task gives at most k counts a window.  The
counts are summed, the digit that holds the k-th row is found, and the next pass refines only that digit;
a window is done when its last digit is known or the digits down to there hold few rows.  Then the
rows down to the k-th key alone are gathered, of which each task gives its first k.

Anchors are taken in blocks of ANCHORS; a block's vectors and windows, of bounded size, are broadcast and
every pass reads all rows once.  Rows are dealt by nothing but their files, so no label or vector,
however frequent, is a hot key, and ties (copies of one vector) cost k rows a task.

Rows with a null label, a null vector, or a null or non-finite component take no part; an empty vector scores
0, and of vectors of different lengths the shorter counts as filled up with zeros.  Components and scores
beyond 64 bits are held at their limits.  Repeated rows are rows of their own: a
copy of an anchor is another row, and a repeated anchor has its rows twice.  A null vec_id is no anchor and
comes behind all others in ties.  Only vec_id, embedding and label are read.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exclusive_offsets, own_dir, removed, saved, table
from .texts import flat

POSITIVES, NEGATIVES = 5, 5
RATIO = (80, 100)
#: Every such vec_id is an anchor.
EVERY = 100
#: Anchors of a block; rows scored at a time.
ANCHORS = 4096
ROWS = 512
#: Bits of a digit; a digit is not refined where the rows down to it are at most so many times k.
DIGIT_BITS = 8
SPARE = 8
#: Stands for a null vec_id: the greatest.
NO_ID = (1 << 63) - 1
#: Sums below are exact in doubles.
EXACT = 1 << 53

MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole(rows: DataFrame) -> DataFrame:
    """(row, vec_id, label, vector) of the rows that take part: ``row`` is a number of their own."""
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter("label is not null and embedding is not null").filter(real)
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))


def blocks(anchors: DataFrame, size: int) -> DataFrame:
    """``anchors`` with ``block``: numbers in blocks of ``size``, by prefix sums over the parts of their row numbers."""
    parted = anchors.withColumn("part", F.shiftright("row", 33))
    bases = exclusive_offsets(parted.groupBy("part").agg(F.count("*").alias("n")), "part", "n")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("row")) - 1
    return parted.withColumn("inside", inside).join(bases, "part").withColumn("block", F.floor((F.col("base") + F.col("inside")) / size)).drop("part", "inside", "base", "n")


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of numbers, cut or filled with zeros to ``width``: what is cut meets zeros."""
    items, row = flat(vectors)
    sizes = np.bincount(row, minlength=len(vectors))
    out = np.zeros((len(vectors), width), np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    here = place < width
    out[row[here], place[here]] = items.to_numpy()[here]
    return out


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond 64 bits they are held at the limits."""
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    bound = most(rows) * most(anchors) * max(1, rows.shape[1])
    if bound < EXACT:
        return (rows.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return rows @ anchors.T
    return np.clip(rows.astype(object) @ anchors.astype(object).T, -NO_ID, NO_ID).astype(np.int64)


def scored(batches, block: dict):
    """(scores of rows by anchors, vec_ids, labels, row numbers), some rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            ids = part.column("vec_id").fill_null(NO_ID).to_numpy()
            yield products(matrix(part.column("vector"), block["vector"].shape[1]), block["vector"]), ids, part.column("label").to_numpy(), part.column("row").to_numpy()


def leading(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of each group's first k, by score, then vec_id, then row; their ranks from 0)."""
    order = np.lexsort((row, vec_id, -score, group))
    g = group[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    first = np.flatnonzero(new)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[rank < k], rank[rank < k]


def firsts(rows: DataFrame, block: dict, k: int) -> DataFrame:
    """(target, score, vec_id, row): each task's first k rows of the anchor's label, the anchor itself left out."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        own = shared.value
        none = np.zeros(0, np.int64)
        held, least = (none, none, none, none), np.full(len(own["label"]), -NO_ID - 1)
        for score, vec_id, label, row in scored(batches, own):
            r, a = np.nonzero((label[:, None] == own["label"]) & (row[:, None] != own["row"]) & (score >= least))
            held = tuple(np.concatenate(x) for x in zip(held, (a, score[r, a], vec_id[r], row[r]), strict=True))
            at, rank = leading(*held, k)
            held = tuple(x[at] for x in held)
            last = held[0][rank == k - 1]
            least[last] = held[1][rank == k - 1]
        yield batch_of("target", *held)

    return rows.mapInArrow(run, "target int, score long, vec_id long, row long")


def batch_of(name: str, target: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(target.astype(np.int32)), pa.array(score), pa.array(vec_id), pa.array(row)], names=[name, "score", "vec_id", "row"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k of the tasks' rows of each target, with their rank from 1."""
    order = Window.partitionBy("target").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Windows:
    """The windows of a block: for each its anchor, its least and greatest score, and how far its
    k-th row is known: ``base`` keys are above the digit in question, which is ``shift`` bits up."""

    def __init__(self, anchor: np.ndarray, positive: np.ndarray, k: int):
        least = [-((-RATIO[0] * p) // 100) for p in positive.tolist()]
        top = [RATIO[1] * p // 100 for p in positive.tolist()]
        self.anchor, self.top = anchor, np.array(top, np.int64)
        self.size = np.array([max(0, min(b - a + 1, NO_ID)) for a, b in zip(least, top, strict=True)], np.int64)
        self.need = np.full(len(anchor), k, np.int64)
        self.base = np.zeros(len(anchor), np.int64)
        bits = np.array([int(n - 1).bit_length() if n > 0 else 0 for n in self.size.tolist()], np.int64)
        self.shift = np.maximum(0, bits - DIGIT_BITS)
        #: Keys from 0 up to here are gathered, once the window is done.
        self.until = self.size - 1
        self.open = self.size > 0

    def keys(self, score: np.ndarray, anchor: np.ndarray, pick: np.ndarray):
        """(the scores' places, windows and keys) for the windows ``pick`` of the scores' anchors that hold them."""
        order = pick[np.argsort(self.anchor[pick], kind="stable")]
        lo, hi = np.searchsorted(self.anchor[order], [anchor, anchor + 1])
        at = np.repeat(np.arange(len(score)), hi - lo)
        window = order[np.arange(len(at)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        inside = (score[at] <= self.top[window]) & (score[at] >= self.top[window] - (self.size[window] - 1))
        at, window = at[inside], window[inside]
        return at, window, self.top[window] - score[at]

    def located(self, window: np.ndarray, digit: np.ndarray, before: np.ndarray, count: np.ndarray, k: int) -> None:
        """Takes in the digit that holds the k-th row of each window, the rows before it and in it; the windows
        that are open and not named hold fewer than k rows, all of which are gathered."""
        named = np.zeros(len(self.open), bool)
        named[window] = True
        self.open &= named
        self.base[window] += digit << self.shift[window]
        last = (self.shift[window] == 0) | (k - self.need[window] + before + count <= SPARE * k)
        done = window[last]
        self.until[done] = np.minimum(self.size[done] - 1, self.base[done] + (1 << self.shift[done]) - 1)
        self.open[done] = False
        self.need[window] -= before
        self.shift[window] = np.maximum(0, self.shift[window] - DIGIT_BITS)


def in_reach(score: np.ndarray, label: np.ndarray, block: dict, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, anchors) of other labels with scores between the anchor's bounds."""
    return np.nonzero((label[:, None] != block["label"]) & (score >= least) & (score <= most))


def bounds(windows: Windows, pick: np.ndarray, low_key: np.ndarray, anchors: int) -> tuple[np.ndarray, np.ndarray]:
    least, most = np.full(anchors, NO_ID), np.full(anchors, -NO_ID)
    np.minimum.at(least, windows.anchor[pick], windows.top[pick] - low_key[pick])
    np.maximum.at(most, windows.anchor[pick], windows.top[pick])
    return least, most


def histograms(rows: DataFrame, block: dict, windows: Windows) -> DataFrame:
    """(window, digit, n) of the open windows, from each task the digits of its own first ``need`` rows."""
    shared = rows.sparkSession.sparkContext.broadcast((block, windows))

    def run(batches):
        own, w = shared.value
        pick = np.flatnonzero(w.open)
        number = np.full(len(w.open), -1)
        number[pick] = np.arange(len(pick))
        counts = np.zeros((len(pick), 1 << DIGIT_BITS), np.int64)
        reach = np.minimum(w.size - 1, w.base + (1 << (w.shift + DIGIT_BITS)) - 1)
        least, most = bounds(w, pick, reach, len(own["label"]))
        for score, _, label, _ in scored(batches, own):
            r, a = in_reach(score, label, own, least, most)
            at, window, key = w.keys(score[r, a], a, pick)
            digit = (key - w.base[window]) >> w.shift[window]
            here = (key >= w.base[window]) & (digit < 1 << DIGIT_BITS)
            counts += np.bincount(number[window[here]] << DIGIT_BITS | digit[here], minlength=counts.size).reshape(counts.shape)
        before = np.cumsum(counts, axis=1) - counts
        i, digit = np.nonzero((counts > 0) & (before < w.need[pick][:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(pick[i].astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(counts[i, digit]), pa.array(w.need[pick][i])], names=["window", "digit", "n", "need"])

    return rows.mapInArrow(run, "window int, digit int, n long, need long")


def kth(counts: DataFrame) -> DataFrame:
    """(window, digit, before, n): the digit that holds the window's k-th row, if there are so many."""
    summed = counts.groupBy("window", "digit").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    upto = F.sum("n").over(Window.partitionBy("window").orderBy("digit"))
    reached = summed.withColumn("upto", upto).filter("upto >= need")
    return reached.groupBy("window").agg(F.min_by(F.struct("digit", (F.col("upto") - F.col("n")).alias("before"), "n"), "digit").alias("k")).select("window", "k.*")


def gathered(rows: DataFrame, block: dict, windows: Windows, k: int) -> DataFrame:
    """(target, score, vec_id, row): of the rows down to each window's k-th key, each task's first k."""
    shared = rows.sparkSession.sparkContext.broadcast((block, windows))

    def run(batches):
        own, w = shared.value
        pick = np.flatnonzero(w.size > 0)
        least, most = bounds(w, pick, w.until, len(own["label"]))
        none = np.zeros(0, np.int64)
        held = (none, none, none, none)
        for score, vec_id, label, row in scored(batches, own):
            r, a = in_reach(score, label, own, least, most)
            s = score[r, a]
            at, window, key = w.keys(s, a, pick)
            here = key <= w.until[window]
            at, window = at[here], window[here]
            held = tuple(np.concatenate(x) for x in zip(held, (window, s[at], vec_id[r[at]], row[r[at]]), strict=True))
            first, _ = leading(*held, k)
            held = tuple(x[first] for x in held)
        yield batch_of("target", *held)

    return rows.mapInArrow(run, "target int, score long, vec_id long, row long")


def mined_block(rows: DataFrame, anchors: list, positives: int, negatives: int) -> DataFrame:
    spark = rows.sparkSession
    width = max([len(a["vector"]) for a in anchors])
    vectors = pa.array([a["vector"] for a in anchors], pa.list_(pa.int64()))
    block = {"vector": matrix(vectors, width), "label": np.array([a["label"] for a in anchors]), "row": np.array([a["row"] for a in anchors])}
    best = ranked(firsts(rows, block, positives), positives).orderBy("target", "rank").collect()  # at most ANCHORS * POSITIVES rows
    windows = Windows(np.array([b["target"] for b in best], np.int64), np.array([b["score"] for b in best], np.int64), negatives)
    while windows.open.any():
        got = kth(histograms(rows, block, windows)).collect()  # a row for each window at most
        windows.located(*[np.array([g[c] for g in got], np.int64) for c in ("window", "digit", "before", "n")], negatives)
    found = ranked(gathered(rows, block, windows, negatives), negatives)
    named = [(i, anchors[b["target"]]["vec_id"], b["vec_id"], b["score"]) for i, b in enumerate(best)]
    names = spark.createDataFrame(named, "target int, anchor_id long, positive_id long, positive_score long")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    out = found.join(F.broadcast(names), "target").withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    return out.select("anchor_id", real("positive_id"), "rank", real("negative_id"), "positive_score", "negative_score")


def mined(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """For each anchor (a vec_id divisible by ``every``) and positive, the first negatives in the window."""
    spark = vectors.sparkSession
    rows = saved(whole(vectors))
    chosen = rows.filter(F.col("vec_id") % every == 0)
    numbered = saved(blocks(chosen, ANCHORS))
    last = numbered.agg(F.max("block")).first()[0]
    path = own_dir(spark, "mined")
    spark.createDataFrame([], MINED).write.parquet(path)
    for number in range(0 if last is None else last + 1):
        anchors = numbered.filter(F.col("block") == number).select("row", "vec_id", "label", "vector").orderBy("row").collect()  # ANCHORS rows
        mined_block(rows, anchors, positives, negatives).write.mode("append").parquet(path)
    removed(numbered, rows)
    return spark.read.schema(MINED).parquet(path)


def op12_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors, with a seventh of the labels moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings").withColumn("label", moved))


OP12_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM whole a JOIN whole r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""
