"""Substring dedup: exact repeats of at least WINDOW words, by fixed-block anchors.

1. The index: every document's words are cut into blocks of BLOCK words that do not
   overlap, so that each window of WINDOW words holds a whole block.
2. The probe: the hash of every run of BLOCK words, wherever it starts.  A block that is
   met anywhere else, in another document or in its own, is an anchor.
3. The extension: an anchor's hits grow to both sides as far as whole windows agree.  A window
   that holds an anchor is looked up by its own hash (96 bits), and the repeated windows that
   follow one another or overlap make up one maximal repeat, a span of words.
   A window without an anchor has no equal, and is not looked up.

Texts are worked on in slices of whole documents.  A slice asks each range of the hashes once, with
a sorted list of the distinct hashes that it has there, and is answered with the places of those that
are repeated; hashes, never places or texts, meet in a task.  So a passage that is found in a
third of all documents puts one entry for each slice into its range, like any other, and no pair
of documents is ever made.  A slice's text waits in the shared folder, compressed, and moves
to its answers twice; what is asked goes straight into the shuffle.

Words are runs of characters other than the six ASCII white-space ones, compared as they
stand.  Null and empty texts have no words; texts of less than WINDOW words lose none.  Repeated rows
are documents like others and lose what they share.  A doc_id may be null or
occur again.  A document is in one task as a whole, which takes about 30 times its bytes.
Only doc_id and text are read, so other columns' names don't matter.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .near_dedup import M1, mixed
from .texts import give_back, sliced, split_words

WINDOW = 35
#: Bytes of text in a slice; bytes of text whose hashes meet in one range.
SLICE_BYTES = 4 << 20
RANGE_BYTES = 8 << 20
#: Bits of the hashes that are probed; the flags beside them.
PROBED = 48
TWICE, ANCHOR = 2, 1

ASKED = "slice long, range int, n int, blob binary, rest binary"
FOUND = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, text string"


def packed(values: np.ndarray, width: int) -> bytes:
    """Whole numbers of ``width`` bytes, in byte planes: those of sorted numbers hardly take room."""
    planes = np.ascontiguousarray(np.asarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def unpacked(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs: those of ``a`` each followed by that of ``b``."""
    n = min(len(a), len(b))
    return mixed(a[:n] * M1 + b[:n])


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, put together from runs of 1, 2, 4, ... words."""
    out, done, part, size = None, 0, words, 1
    with np.errstate(over="ignore"):
        while size <= k:
            if k & size:
                out = part if out is None else joined(out, part[done:])
                done += size
            part, size = joined(part, part[size:]), size * 2
    return out[: max(0, len(words) - k + 1)]


class Slice:
    """The words of some texts, with their hashes in two lanes."""

    def __init__(self, texts: pa.Array, window: int = WINDOW):
        self.window, self.block, self.n = window, (window + 1) // 2, len(texts)
        self.words, self.row = split_words(texts)
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in self.words.dictionary.to_pylist()), "<u8").reshape(-1, 2)
        self.lanes, self.code = digests, self.words.indices.to_numpy()
        counts = np.bincount(self.row, minlength=self.n)
        self.starts = np.cumsum(counts) - counts
        self.counts = counts
        self.place = np.arange(len(self.row)) - np.repeat(self.starts, counts)

    def lane(self, i: int) -> np.ndarray:
        return self.lanes[self.code, i] if len(self.code) else np.zeros(0, np.uint64)

    def inside(self, k: int) -> np.ndarray:
        """Whether the run of k words that starts there is all in one text."""
        n = max(0, len(self.row) - k + 1)
        return self.row[k - 1 :][:n] == self.row[:n]

    def probes(self) -> np.ndarray:
        """Sorted distinct hashes of the runs of a block's length, cut to PROBED bits, with their flags."""
        h = runs(self.lane(0), self.block)
        here = self.inside(self.block)
        anchor = self.place[: len(h)] % self.block == 0
        return distinct_probes(h[here], anchor[here])

    def held(self, anchors: np.ndarray) -> np.ndarray:
        """The starts of windows that hold one of ``anchors`` (sorted hashes) as a whole block."""
        h = runs(self.lane(0), self.block) >> np.uint64(64 - PROBED)
        known = member(h, anchors)
        start = np.flatnonzero(self.inside(self.window))
        return start[known[start + (-self.place[start]) % self.block]]

    def keys(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the windows' hashes, as 64 and 32."""
        first, second = (runs(self.lane(i), self.window)[start] for i in (0, 1))
        return first, second >> np.uint64(32)

    def spans(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each word is in a window that starts at ``start``, and whether it opens a span)."""
        edge = np.zeros(len(self.row) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.window, -1)
        covered = np.cumsum(edge[:-1]) > 0
        opens = covered.copy()
        opens[1:] &= ~covered[:-1] | (self.row[1:] != self.row[:-1])
        return covered, opens

    def result(self, doc_id: pa.Array, start: np.ndarray) -> pa.RecordBatch:
        covered, opens = self.spans(start)
        gone = np.bincount(self.row[covered], minlength=self.n)
        kept = self.words.filter(pa.array(~covered))
        kept = pa.ListArray.from_arrays(np.r_[0, np.cumsum(self.counts - gone)].astype(np.int32), kept.cast(pa.string()))
        first = np.flatnonzero(opens)
        number = np.cumsum(opens) - 1
        length = np.bincount(number[covered], minlength=len(first))
        spans = pa.StructArray.from_arrays([pa.array(self.place[first]), pa.array(self.place[first] + length)], names=["start", "stop"])
        spans = pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.bincount(self.row[first], minlength=self.n))].astype(np.int32), spans)
        return pa.RecordBatch.from_arrays([doc_id.cast(pa.int64()), pa.array(self.counts.astype(np.int64)), pa.array(gone.astype(np.int64)), spans, pc.binary_join(kept, " ")], names=["doc_id", "n_words", "n_removed", "spans", "text"])


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``values`` are ``among`` sorted numbers."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def distinct_probes(h: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    keyed = np.sort((h >> np.uint64(64 - PROBED)) << np.uint64(1) | anchor.astype(np.uint64))
    first, last = ends(keyed >> np.uint64(1))
    twice = (last > first).astype(np.uint64)
    return (keyed[last] >> np.uint64(1)) << np.uint64(2) | twice << np.uint64(1) | (keyed[last] & np.uint64(1))


def ends(*sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of equal keys."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    first = np.flatnonzero(new)
    return first, np.r_[first[1:], n][: len(first)] - 1


def cuts(top: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted 32-bit numbers dealt to ranges of equal width."""
    number = (top * np.uint64(ranges)) >> np.uint64(32)
    first, last = ends(number) if len(number) else (np.zeros(0, int), np.zeros(0, int))
    return [(int(number[a]), int(a), int(b) + 1) for a, b in zip(first, last, strict=True)]


def request(rows: list[tuple[int, int, int, bytes, bytes | None]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["slice", "range", "n", "blob", "rest"])


def frozen(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def thawed(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_next_batch()


def slices(rows: DataFrame) -> DataFrame:
    """(slice, blob): some texts each, compressed, under a number of their own."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, most=SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([frozen(batch)], pa.binary())], names=["slice", "blob"])
            number += 1

    return rows.mapInArrow(run, "slice long, blob binary")


def probed(texts: DataFrame, ranges: int, window: int) -> DataFrame:
    """What each slice asks about its blocks and runs."""

    def run(batches):
        for batch in batches:
            for number, blob in zip(batch.column("slice").to_pylist(), batch.column("blob"), strict=True):
                asked = Slice(thawed(blob.as_py()).column("text"), window).probes()
                yield request([(number, r, b - a, packed(asked[a:b], 7), None) for r, a, b in cuts(asked >> np.uint64(2 + PROBED - 32), ranges)])
                give_back()

    return texts.mapInArrow(run, ASKED)


def anchors_of(asked: pa.Table) -> pa.Table:
    """To each slice: which of its blocks are anchors."""
    slices, number = asked.column("slice").to_pylist(), asked.column("range")[0].as_py()
    values = np.concatenate([unpacked(b, 7) for b in asked.column("blob").to_pylist()])
    owner = np.repeat(np.arange(len(slices)), asked.column("n").to_numpy())
    order = np.argsort(values >> np.uint64(2), kind="stable")
    values, owner = values[order], owner[order]
    first, last = ends(values >> np.uint64(2))
    often = (last > first) | (np.maximum.reduceat(values & np.uint64(TWICE), first) > 0)
    hit = np.repeat(often, last - first + 1) & (values & np.uint64(ANCHOR) > 0)
    values, owner = values[hit] >> np.uint64(2), owner[hit]
    order = np.argsort(owner, kind="stable")
    first, last = ends(owner[order])
    return pa.Table.from_batches([request([(slices[owner[order[a]]], number, int(b - a) + 1, packed(values[order[a : b + 1]], 6), None) for a, b in zip(first.tolist(), last.tolist(), strict=True)])])


def asked_windows(mine: Slice, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64 bits, 32 bits and a flag, of the distinct windows in order; the number of each window's)."""
    top, rest = mine.keys(start)
    order = np.lexsort((rest, top))
    first, last = ends(top[order], rest[order])
    which = np.empty(len(start), np.int64)
    which[order] = np.repeat(np.arange(len(first)), last - first + 1)
    return top[order][first], rest[order][first], last > first, which


def told_anchors(told: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *[unpacked(b, 6) for b in told.column("blob").to_pylist()]]))


def extended(texts: DataFrame, anchors: DataFrame, ranges: int, window: int) -> DataFrame:
    """What each slice asks about its windows that hold an anchor."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if len(own) and len(told):
            mine = Slice(thawed(own.column("blob")[0].as_py()).column("text"), window)
            top, rest, twice, _ = asked_windows(mine, mine.held(told_anchors(told)))
            rest, number = rest << np.uint64(1) | twice.astype(np.uint64), own.column("slice")[0].as_py()
            rows = [(number, r, b - a, packed(top[a:b], 8), packed(rest[a:b], 5)) for r, a, b in cuts(top >> np.uint64(32), ranges)]
        give_back()
        return pa.Table.from_batches([request(rows)])

    return texts.groupBy("slice").cogroup(anchors.groupBy("slice")).applyInArrow(run, ASKED)


def repeated(asked: pa.Table) -> pa.Table:
    """To each slice: a bit for each of the windows it asked about, set where it is repeated."""
    slices, ranges, sizes = (asked.column(c).to_pylist() for c in ("slice", "range", "n"))
    top, rest = (np.concatenate([unpacked(b, width) for b in asked.column(c).to_pylist()]) for c, width in (("blob", 8), ("rest", 5)))
    twice, rest = rest & np.uint64(1) > 0, rest >> np.uint64(1)
    order = np.lexsort((rest, top))
    first, last = ends(top[order], rest[order])
    often = np.empty(len(top), bool)
    often[order] = np.repeat((last > first) | np.logical_or.reduceat(twice[order], first), last - first + 1)
    at = np.r_[0, np.cumsum(sizes)].tolist()
    return pa.Table.from_batches([request([(s, r, n, None, np.packbits(often[a : a + n]).tobytes()) for s, r, n, a in zip(slices, ranges, sizes, at, strict=False)])])


def finished(texts: DataFrame, told: DataFrame, window: int) -> DataFrame:
    """``told``: the anchors, and behind them the windows, with ``rest`` null or not."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        batch = thawed(own.column("blob")[0].as_py())
        mine, start = Slice(batch.column("text"), window), np.zeros(0, np.int64)
        about_windows = pc.is_valid(told.column("rest"))
        if pc.any(about_windows).as_py():
            start = mine.held(told_anchors(told.filter(pc.invert(about_windows))))
            bits = told.filter(about_windows).sort_by("range")
            often = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for n, b in zip(bits.column("n").to_pylist(), bits.column("rest").to_pylist(), strict=True)]) > 0
            start = start[often[asked_windows(mine, start)[3]]]
        out = mine.result(batch.column("doc_id"), start)
        give_back()
        return pa.Table.from_batches([out])

    return texts.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(run, FOUND)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, spans (the maximal repeats, as
    word numbers from ``start`` up to ``stop``) and text, the other words joined by one space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES
    texts = saved(slices(rows))
    anchors = saved(probed(texts, ranges, window).groupBy("range").applyInArrow(anchors_of, ASKED))
    windows = extended(texts, anchors, ranges, window).groupBy("range").applyInArrow(repeated, ASKED)
    return finished(texts, anchors.unionAll(windows), window)


def op13_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of exact repeats, as a digest of what is kept."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
