"""Token-id output: bit-plane shuffling.

Documents are range-sorted by doc_id; each partition becomes one shard file.
A shard's ids are cut into blocks of fixed size, each block is transposed into
byte planes (or bit planes), and each plane is compressed by itself with
zstandard: the high planes of token ids hardly vary and shrink to almost
nothing.

    file    := plane* documents index length magic
    plane   := zstandard frame
    documents := zstandard frame of (doc_id int64, n_tokens int64) columns
    index   := JSON {"width", "planes", "block", "blocks": [[ids, [bytes of each plane]]], "documents": [rows, bytes]}
    length  := uint32, bytes of index;  magic := b"QLBP"

A shard is written under a name of its own attempt, and the manifest names the file of the
attempt that counts: nothing is renamed, so a task that runs again, or twice, never meets
another's file (files of lost attempts stay unread).  Null or empty text: the end
id alone.  Documents that share a doc_id stand side by side, ordered by text; a null doc_id
comes first and is kept in the file as the least 64-bit number, which no document may have.
A document longer than memory cannot be encoded.
An empty table gives shards without documents, or none.  Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exclusive_offsets, own_dir, saved, small, table
from .packing import binaries, with_end
from .texts import give_back
from .tokens import slices, tokenizer_path, word_encoder

BLOCK_IDS = 1 << 16
END_ID = 1
MAGIC = b"QLBP"
#: Stands for a null doc_id in the files.
NO_ID = -(1 << 63)
MANIFEST = "shard int, path string, n_docs long, total long, n_bytes long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The byte planes, or bit planes, of a block of ids, lowest first."""
    rows = np.ascontiguousarray(ids.view(np.uint8).reshape(-1, ids.itemsize).T)
    if kind == "byte":
        return [r.tobytes() for r in rows]
    return [np.packbits(r >> b & 1).tobytes() for r in rows for b in range(8)]


def from_planes(planes: list[bytes], n: int, dtype: np.dtype, kind: str) -> np.ndarray:
    if kind == "byte":
        rows = [np.frombuffer(p, np.uint8) for p in planes]
    else:
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes]
        rows = [sum((bits[8 * i + b] << b for b in range(8)), np.zeros(n, np.uint8)) for i in range(dtype.itemsize)]
    return np.ascontiguousarray(np.stack(rows, axis=1)).reshape(-1).view(dtype)


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    def __init__(self, folder: str, name: str, dtype: np.dtype, planes: str, block: int):
        self.fs, where = filesystem(folder)
        self.fs.create_dir(where)
        self.name = f"{name}-{uuid.uuid4().hex}.qlbp"
        self.out, self.dtype, self.planes, self.block = self.fs.open_output_stream(f"{where}/{self.name}"), dtype, planes, block
        self.zstd, self.rest, self.index, self.docs, self.n_ids, self.n_bytes = zstandard.ZstdCompressor(3), np.zeros(0, dtype), [], [], 0, 0

    def put(self, data: bytes) -> int:
        self.out.write(data)
        self.n_bytes += len(data)
        return len(data)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(np.stack([doc_ids, counts]))
        self.n_ids += len(ids)
        held = np.concatenate([self.rest, ids.astype(self.dtype, copy=False)])
        whole = len(held) // self.block * self.block
        for at in range(0, whole, self.block):
            self.flush(held[at : at + self.block])
        self.rest = held[whole:].copy()

    def flush(self, ids: np.ndarray) -> None:
        self.index.append([len(ids), [self.put(self.zstd.compress(p)) for p in to_planes(ids, self.planes)]])

    def close(self) -> tuple[int, int, int]:
        if len(self.rest):
            self.flush(self.rest)
        docs = np.concatenate(self.docs, axis=1) if self.docs else np.zeros((2, 0), np.int64)
        size = self.put(self.zstd.compress(docs.astype("<i8").tobytes()))
        index = json.dumps({"width": self.dtype.itemsize, "planes": self.planes, "block": self.block, "blocks": self.index, "documents": [docs.shape[1], size]}).encode()
        self.put(index + struct.pack("<I", len(index)) + MAGIC)
        self.out.close()
        return docs.shape[1], self.n_ids, self.n_bytes


def read_shard(path: str):
    """Yields (doc_ids, ids, counts) of a shard, about a block at a time."""
    files, where = filesystem(path)
    with files.open_input_file(where) as f:
        size = f.size()
        length, magic = struct.unpack("<I4s", f.read_at(8, size - 8))
        if magic != MAGIC:
            raise ValueError(f"{path}: not a bit-plane shard")
        index = json.loads(f.read_at(length, size - 8 - length))
        n_docs, doc_bytes = index["documents"]
        unpack = zstandard.ZstdDecompressor().decompress
        docs = np.frombuffer(unpack(f.read_at(doc_bytes, size - 8 - length - doc_bytes)), "<i8").reshape(2, n_docs)
        dtype, at, done, rest, most = np.dtype(f"<u{index['width']}"), 0, 0, [], index["block"] * index["width"]
        ends = np.cumsum(docs[1])
        read = 0
        for n, sizes in index["blocks"]:
            data, planes = f.read_at(sum(sizes), at), []
            at += sum(sizes)
            for s in sizes:
                planes.append(unpack(data[:s], max_output_size=most))
                data = data[s:]
            rest.append(from_planes(planes, n, dtype, index["planes"]))
            read += n
            upto = int(np.searchsorted(ends, read, "right"))
            if upto > done:
                counts, held = docs[1][done:upto], np.concatenate(rest)
                yield docs[0][done:upto], held[: counts.sum()], counts
                rest, done = [held[counts.sum() :].copy()], upto


def write_bitplanes(docs: DataFrame, folder: str, planes: str = "byte", end_id: int = END_ID, block: int = BLOCK_IDS, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards, in ascending doc_id order; returns the manifest, one row a shard."""
    path = tokenizer_path(path=tokenizer)

    def run(batches):
        shard, encoder = TaskContext.get().partitionId(), word_encoder(path)
        writer = ShardWriter(folder, f"shard-{shard:06d}", encoder.dtype, planes, block)
        for batch in batches:
            for a, n in slices(batch.column("text")):
                cut = batch.slice(a, n)
                ids, counts = with_end(*encoder.encode(cut.column("text")), end_id)
                writer.add(pc.fill_null(cut.column("doc_id"), NO_ID).to_numpy(), ids, counts)
            give_back()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{writer.name}"} | dict(zip(("n_docs", "total", "n_bytes"), writer.close(), strict=True))], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("total", pa.int64()), ("n_bytes", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return saved(ordered.mapInArrow(run, MANIFEST))


def read_bitplanes(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): from the files, ``start`` counted over all shards before."""
    shards = manifest.count()
    placed = manifest.join(small(exclusive_offsets(manifest.select("shard", "total"), "shard", "total").select("shard", "base"), shards), "shard")
    placed = placed.repartitionByRange(max(1, shards), "shard")  # one shard a task

    def run(batches):
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                for doc_ids, ids, counts in read_shard(path):
                    starts = at + np.cumsum(counts) - counts
                    at += int(counts.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(starts), pa.array(counts), binaries(ids.astype("<u4"), counts)], names=["doc_id", "start", "n_tokens", "ids"])

    return placed.select("path", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op6_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as bit-plane shards and read back from them."""
    manifest = write_bitplanes(table(spark, sf_dir, "documents"), own_dir(spark, "bitplanes"))
    return read_bitplanes(manifest).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
