"""Quality rules: an isolation forest on rule statistics.

Every document's rule statistics (symbols, repeated lines and word windows,
capitals, exclamation marks, word lengths, distinct words) are scored by random
trees: the fewer random splits it takes to set a document apart, the more
anomalous it is (Liu, Ting and Zhou, 2008).  The trees hold all labelled good rows
and are cut over the ranges of all labelled rows, for junk is too frequent here to
be isolated among its like.  Instead of drawing SUBSAMPLE rows for each tree, a leaf's
depth is the expected one over all such draws, from the counts of all good rows in
each node.  The threshold is the score that best tells all labelled good rows from bad
ones while at least KEEP of the good ones stay.  Statistics, scores and decisions
cover every document.  Rows that fail the base rule take no part in the forest.

Null or empty text has no words and fails the base rule.  Without labelled rows
of both kinds no score is a reject, and only the base rule decides; without any
labelled row the forest is empty and the score 0.  Repeated rows are judged
alike.  An empty table stays empty.  ``accepted`` keeps all columns as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import exclusive_offsets, removed, saved, table
from .texts import codes_of, flat, per_row, sliced, split_words

SUBSAMPLE = 256
TREES = 100
DEPTH = 16
#: A node is cut where two rows of a draw meet in it with at least this chance.
RARE = 0.001
#: Levels that the trees grow at a time.
LEVELS = 4
KEEP = 0.998
#: Rows scored at a time: a dozen arrays of CHUNK x TREES numbers live at once.
CHUNK = 2048
#: Bytes of text that are measured at a time: their words and windows take some thirty times as much.
SLICE_BYTES = 1 << 20
#: Buckets of scores in the running sums.
BUCKETS = 16384

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims", "n_distinct")
FEATURES = tuple(f"x{k}" for k in range(6))
MEASURED = ", ".join(["doc_id long", *[f"{c} long" for c in STATS[:5]], "base_failed boolean", *[f"{c} double" for c in FEATURES]])


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The rule statistics of each text."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    words, row = split_words(texts)
    code, size = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    lengths = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False)
    out = {"n_words": per_row(row, n), "word_chars": per_row(row, n, lengths[code] if len(code) else None)}
    out["n_symbols"] = pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy().astype(np.int64)

    # Three-word windows of one text, numbered exactly: pairs first, so that no number overflows.
    covered = np.zeros(len(code), bool)
    if len(code) > 2:
        inside = row[2:] == row[:-2]
        pair = codes_of(code[:-1] * size + code[1:]).astype(np.int64)
        window = codes_of((pair[:-1] * size + code[2:])[inside]).astype(np.int64)
        number = codes_of(window * n + row[2:][inside])
        again = np.zeros(len(code) - 2, bool)
        again[inside] = np.bincount(number)[number] > 1
        for k in range(3):
            covered[k : len(code) - 2 + k] |= again
    out["n_repeat_words"] = per_row(row[covered], n)

    lines, at = flat(pc.split_pattern(texts, "\n"))
    lines = lines.dictionary_encode()
    some = pc.not_equal(pc.ascii_trim_whitespace(lines.dictionary), "").to_numpy(zero_copy_only=False)
    line = lines.indices.to_numpy().astype(np.int64)
    full = some[line] if len(line) else np.zeros(0, bool)
    line, at = line[full], at[full]
    out["n_lines"] = per_row(at, n)
    out["n_dup_lines"] = out["n_lines"] - per_row(np.unique(line * n + at) % n, n) if n else out["n_lines"]
    out["n_capitals"] = pc.count_substring_regex(texts, r"\p{Lu}").to_numpy().astype(np.int64)
    out["n_exclaims"] = pc.count_substring(texts, "!").to_numpy().astype(np.int64)
    out["n_distinct"] = per_row(np.unique(code * n + row) % n, n) if n else out["n_words"]
    return out


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row of ratios for each text; none depends on its length."""
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.log1p(10 * np.stack([s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_capitals"] / chars, s["n_exclaims"] / words, s["word_chars"] / words], axis=1))


def ranges(x: np.ndarray) -> np.ndarray:
    """Lowest and highest value of each feature."""
    return np.stack([x.min(axis=0), x.max(axis=0)]) if len(x) else np.zeros((2, x.shape[1]))


def path_length(n: float) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def chance_to_meet(mass: np.ndarray, n: int, rows: int) -> np.ndarray:
    """The chance that ``rows`` of ``n`` rows, drawn at random, hold at least two of ``mass`` rows."""
    kinds, at = np.unique(mass, return_inverse=True)
    none, one = np.ones(len(kinds)), kinds * (rows / n)
    for k in range(rows):
        none *= np.maximum(n - kinds - k, 0) / (n - k)
        if k < rows - 1:
            one *= np.maximum(n - kinds - k, 0) / (n - 1 - k)
    return np.maximum(1 - none - one, 0)[at]


@dataclass
class Forest:
    """Trees as flat arrays; node k's children are left[k] and left[k] + 1, a leaf has left 0."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    rows: int
    threshold: float = 2.0

    @staticmethod
    def grow(x: np.ndarray, box: np.ndarray, trees: int = TREES, rows: int = SUBSAMPLE, depth_limit: int = DEPTH, seed: int = 7) -> Forest:
        """``x``: the good rows; ``box``: (lowest, highest) of each feature."""
        return Forest.counted(lambda forest: forest.masses(x), len(x), box, trees, rows, depth_limit, seed)

    @staticmethod
    def counted(masses: Callable[[Forest], np.ndarray], n: int, box: np.ndarray, trees: int = TREES, rows: int = SUBSAMPLE, depth_limit: int = DEPTH, seed: int = 7) -> Forest:
        """Trees over all ``n`` good rows, which only ``masses`` sees: it counts the rows in each leaf
        of a forest, once for LEVELS levels.  A leaf's depth is the expected one over all draws of
        ``rows`` rows: each node above it adds the chance that it holds two rows of a draw, and so
        would be cut.  A node's cut is uniform over its part of the box, so that regions without
        rows end after few splits."""
        rng = np.random.default_rng(seed)
        rows, roots = min(rows, n), np.arange(trees if n else 0)
        forest, mass = Forest(roots * 0, roots * 0.0, roots * 0, roots * 0.0, roots, rows), np.full(len(roots), n)
        front, (lo, hi), top = roots, (np.repeat(side[None, :], len(roots), axis=0) for side in box), 0
        while len(front) and top < depth_limit:
            new = []
            for _ in range(min(LEVELS, depth_limit - top)):
                wide = (hi > lo).any(axis=1)
                front, lo, hi = front[wide], lo[wide], hi[wide]
                new.append(front)
                nth, at = np.cumsum(hi > lo, axis=1), np.arange(len(front))
                f = np.argmax(nth > np.floor(rng.random(len(front)) * nth[:, -1])[:, None], axis=1)
                cut = rng.uniform(lo[at, f], hi[at, f])
                front, lo, hi, top = forest._cut(front, f, cut), np.repeat(lo, 2, axis=0), np.repeat(hi, 2, axis=0), top + 1
                hi[2 * at, f] = lo[2 * at + 1, f] = cut
            mass = masses(forest)
            for inner in reversed(new):
                mass[inner] = mass[forest.left[inner]] + mass[forest.left[inner] + 1]
            meet = chance_to_meet(mass, n, rows)
            for inner in new:
                forest.depth[forest.left[inner]] = forest.depth[forest.left[inner] + 1] = forest.depth[inner] + meet[inner]
            for inner in new:
                forest.left[inner[meet[inner] < RARE]] = 0
            some = meet[front] >= RARE
            front, lo, hi = front[some], lo[some], hi[some]
        forest.depth += [path_length(m * rows / n) for m in np.where(forest.left > 0, 0, mass)]
        return forest._pruned()

    def _cut(self, at: np.ndarray, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
        """Cuts leaves; returns their children."""
        n, k = len(self.left), 2 * len(at)
        self.feature[at], self.split[at], self.left[at] = feature, split, n + np.arange(0, k, 2)
        self.feature, self.split, self.left, self.depth = (np.append(a, np.zeros(k, a.dtype)) for a in (self.feature, self.split, self.left, self.depth))
        return n + np.arange(k)

    def _pruned(self) -> Forest:
        """The same trees without nodes below leaves."""
        used, at = np.zeros(len(self.left), bool), self.roots
        while len(at):
            used[at] = True
            at = self.left[at[self.left[at] > 0]]
            at = np.concatenate([at, at + 1])
        number = np.cumsum(used) - 1
        left = np.where(self.left > 0, number[self.left], 0) if len(used) else self.left
        return Forest(self.feature[used], self.split[used], left[used], self.depth[used], self.roots, self.rows, self.threshold)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        while (inner := self.left[at] > 0).any():
            at = np.where(inner, self.left[at] + (x[row, self.feature[at]] >= self.split[at]), at)
        return at

    def masses(self, x: np.ndarray) -> np.ndarray:
        """The number of rows in each leaf; other nodes have 0."""
        out = np.zeros(len(self.left), np.int64)
        for a in range(0, len(x), CHUNK):
            out += np.bincount(self.leaves(x[a : a + CHUNK]).ravel(), minlength=len(out))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / its expectation): near 1 for outliers, under 0.5 for the many."""
        if not len(self.roots):
            return np.zeros(len(x))
        return np.concatenate([self._score(x[a : a + CHUNK]) for a in range(0, len(x), CHUNK)] or [np.zeros(0)])

    def _score(self, x: np.ndarray) -> np.ndarray:
        return 2.0 ** (-self.depth[self.leaves(x)].mean(axis=1) / max(path_length(self.rows), 1e-9))


def best_threshold(score: np.ndarray, good: np.ndarray, keep: float = KEEP) -> float:
    """The cut with the highest accuracy gain over keeping all (bad rejected less good
    rejected) that rejects no more than 1 - keep of the good rows; 2 (none) if there is no gain."""
    order = np.argsort(-score, kind="stable")
    s, g = score[order], good[order].astype(np.int64)
    lost, gone = np.cumsum(g), np.cumsum(1 - g)
    last = np.flatnonzero(np.append(s[1:] != s[:-1], True)) if len(s) else []
    best, gain = 2.0, 0
    for k in last:
        if lost[k] <= (1 - keep) * g.sum() and gone[k] - lost[k] > gain:
            below = s[k + 1] if k + 1 < len(s) else s[k] - 1e-3
            best, gain = float((s[k] + below) / 2), gone[k] - lost[k]
    return best


def measured(docs: DataFrame) -> DataFrame:
    """The statistics, base rule and features of each document."""

    def run(batches):
        for batch in sliced(batches, most=SLICE_BYTES):
            s = statistics(batch.column("text"))
            arrays = [batch.column("doc_id"), *[pa.array(s[c]) for c in STATS[:5]], pa.array(base_failed(s)), *[pa.array(x) for x in features(s).T]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *STATS[:5], "base_failed", *FEATURES])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEASURED)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], axis=1)


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """``rows``, which hold features, with their scores."""

    def run(batches):
        for batch in batches:
            yield batch.append_column("score", pa.array(forest.score(matrix(batch))))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def leaf_masses(rows: DataFrame, forest: Forest) -> np.ndarray:
    """``Forest.masses`` of the features in ``rows``, counted in tasks; one sum for each leaf comes back."""

    def run(batches):
        out = np.zeros(len(forest.left), np.int64)
        for batch in batches:
            out += forest.masses(matrix(batch))
        leaf = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(out[leaf])], names=["leaf", "n"])

    got = rows.mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(forest.left), np.int64)
    out[got.column("leaf").to_numpy()] = got.column("n").to_numpy()
    return out


def best_threshold_of(rows: DataFrame, keep: float = KEEP) -> float:
    """``best_threshold`` of the columns score and quality, exactly: rows are counted by score,
    and running sums from the highest score down are taken in buckets of scores."""
    good, bad = F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")
    by_score = saved(rows.groupBy("score").agg(good, bad).withColumn("bucket", F.floor((1 - F.col("score")) * BUCKETS)))
    sums = by_score.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    before = exclusive_offsets(sums, "bucket", "good", more=("bad",)).select("bucket", "base", "bad_base")
    down = Window.partitionBy("bucket").orderBy(F.col("score").desc())
    cuts = by_score.join(F.broadcast(before), "bucket").select("score", (F.col("base") + F.sum("good").over(down)).alias("lost"), (F.col("bad_base") + F.sum("bad").over(down)).alias("gone"))
    most = (1 - keep) * (by_score.agg(F.sum("good")).first()[0] or 0)
    best = cuts.filter((F.col("lost") <= F.lit(float(most))) & (F.col("gone") > F.col("lost"))).orderBy((F.col("gone") - F.col("lost")).desc(), F.col("score").desc()).first()
    if best:
        below = by_score.filter(F.col("score") < F.lit(best.score)).agg(F.max("score")).first()[0]
    removed(by_score)
    return (best.score + (best.score - 1e-3 if below is None else below)) / 2 if best else 2.0


def fit_measured(rows: DataFrame, labels: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, keep: float = KEEP) -> Forest:
    """``fit`` on what ``measured`` gave."""
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    one = rows.join(marks, "doc_id").groupBy("doc_id").agg(F.min(F.struct("quality", *rows.columns[1:])).alias("s"))  # a doc_id may stand there often
    known = saved(one.filter("not s.base_failed").select("s.quality", *[f"s.{c}" for c in FEATURES]))
    n, n_good, *ends = known.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0)), *[end(c) for end in (F.min, F.max) for c in FEATURES]).first()
    box = np.array(ends, float).reshape(2, len(FEATURES)) if n else np.zeros((2, len(FEATURES)))
    grown = known.filter("quality = 1") if n_good else known
    forest = Forest.counted(lambda forest: leaf_masses(grown, forest), n_good or n, box, trees, subsample)
    if 0 < n_good < n:
        forest.threshold = best_threshold_of(scored(known, forest), keep)
    removed(known)
    return forest


def fit(docs: DataFrame, labels: DataFrame, trees: int = TREES, rows: int = SUBSAMPLE, keep: float = KEEP) -> Forest:
    """Grows the forest over the features of all labelled documents that pass the base rule and
    sets the threshold by all their labels.  Only narrow rows are joined; no text moves."""
    return fit_measured(measured(docs), labels, trees, rows, keep)


def verdicts(rows: DataFrame, forest: Forest) -> DataFrame:
    """The statistics, base rule, forest score and verdict of each document that was ``measured``."""
    kept = ~F.col("base_failed") & (F.col("score") < F.lit(forest.threshold))
    return scored(rows, forest).select("doc_id", *STATS[:5], "base_failed", kept.alias("kept"), "score")


def judged(docs: DataFrame, forest: Forest) -> DataFrame:
    """The statistics, base rule, forest score and verdict of each document."""
    return verdicts(measured(docs), forest)


def accepted(docs: DataFrame, forest: Forest) -> DataFrame:
    """The documents that are kept, with all their columns."""

    def run(batches):
        for batch in sliced(batches, most=SLICE_BYTES):
            s = statistics(batch.column("text").cast(pa.string()))
            yield batch.filter(pa.array(~base_failed(s) & (forest.score(features(s)) < forest.threshold)))

    return docs.mapInArrow(run, docs.schema)


def op1_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by the base rule and the forest."""
    rows = saved(measured(table(spark, sf_dir, "documents")))
    return verdicts(rows, fit_measured(rows, table(spark, sf_dir, "labels")))
