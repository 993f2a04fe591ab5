"""Packing: concatenate and cut.

All documents' ids, each with an end id, make one long stream that is cut into
windows of fixed size.  The first pass encodes each partition and counts its
ids; a prefix sum over the partition totals gives each partition, and with the
running count inside it each document, a global offset.  The second pass cuts
every document at the window borders it crosses.  Only one row for each
partition is moved between the passes; no text and no id is shuffled.

Null or empty text: the end id alone.  Repeated documents are packed as often
as they stand there.  An empty table gives no piece.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exclusive_offsets, saved, small, table
from .texts import give_back, sliced
from .tokens import slices, tokenizer_path, word_encoder

WINDOW = 4096
END_ID = 2

#: Bytes of stored ids that are cut at a time; pieces of them go back to Spark as one batch.
CUT_BYTES = 1 << 20

TOKENS = "part int, doc_id long, local_start long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, continued boolean, continues boolean"


def binaries(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value for each run of ``counts`` ids."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * ids.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each run."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def encoded(docs: DataFrame, end_id: int, path: str) -> DataFrame:
    """(part, doc_id, local_start, n_tokens, ids): ids in the encoder's width, with the
    end id; local_start counts the ids of the same partition before."""

    def run(batches):
        encoder, part, at = word_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, n in slices(batch.column("text")):
                cut = batch.slice(a, n)
                ids, counts = with_end(*encoder.encode(cut.column("text")), end_id)
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), cut.column("doc_id"), pa.array(starts), pa.array(counts), binaries(ids, counts)], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
            give_back()
        encoder.forget()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENS)


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece: its document, ``start`` there, ``length``, ``ids``
    (little-endian unsigned 32-bit), the document's ids in all, the sequence it lies in and
    ``offset`` there, and whether the document began in an earlier sequence (``continued``) or
    goes on in the next (``continues``).  Only the last sequence can be short."""
    path = tokenizer_path(path=tokenizer)
    tokens = saved(encoded(docs, end_id, path))
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = saved(exclusive_offsets(totals, "part", "total").select("part", "base"))
    placed = tokens.join(small(bases, bases.count()), "part")
    dtype = word_encoder(path).dtype

    def cut(batches):
        for batch in sliced(batches, "ids", CUT_BYTES):
            n = batch.column("n_tokens").to_numpy()
            begin = batch.column("base").to_numpy() + batch.column("local_start").to_numpy()
            first, last = begin // window, (begin + n - 1) // window
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] + k
            lo = np.maximum(begin[row], sequence * window)
            hi = np.minimum((begin + n)[row], (sequence + 1) * window)
            flat = np.concatenate([np.frombuffer(x, dtype) for x in batch.column("ids").to_pylist()] or [np.zeros(0, dtype)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(lo - begin[row]), pa.array(hi - lo), binaries(flat.astype("<u4"), hi - lo), pa.array(n[row]), pa.array(sequence), pa.array(lo - sequence * window), pa.array(k > 0), pa.array(k < pieces[row] - 1)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "continued", "continues"],
            )

    return placed.select("doc_id", "local_start", "n_tokens", "ids", "base").mapInArrow(cut, PIECES)


def op4_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids; one row for each piece."""
    return pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
