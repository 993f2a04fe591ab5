"""Near-duplicate groups: weighted MinHash (improved consistent weighted sampling)
over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Words are lower-cased and stripped to letters and digits; texts with the same
   words are one node (its copies are never paired).  A text's shingles are its
   runs of SHINGLE words (all words if there are fewer; texts without words are
   one node by themselves, null like empty).
2. A shingle weighs (1 + ln tf) * idf.  Document frequencies are counted over all
   documents in a hashed array of fixed size (2 ** DF_BITS counters); what the other
   shingles of a counter add on average is taken off, so that rare shingles look rare
   however many there are.  idf = 1 + DAMP * ln((N + 1) / (df + 1)) / ln(N + 1): damped,
   so that the text shared by a large group of copies still outweighs their differences.
3. BANDS x ROWS consistent weighted samples (Ioffe, 2010) of each node; random
   draws are looked up by shingle hash in a fixed table.  Nodes with an equal band
   share a bucket; two of similarity 0.8 miss each other with probability 0.0002.
4. All pairs of a bucket that are not known to be in one class are compared: linked if
   the weighted Jaccard similarity of the full texts is at least SIMILARITY.
   Classes are the connected components of links.

Pairs are compared inside tasks, as tiles of at most CELL x CELL nodes, and never
become rows; a tile gives no more links than connect its classes.  First the buckets of FIRST
bands, each dealt into tiles of its own parts; then, by the classes so found, in all
buckets that hold more than one class the nodes outside the largest class with all nodes.  So a group of n
near copies takes about n * CELL comparisons, and only nodes that agree in a band
and stay in different classes are compared each with each.

A class is named by its least doc_id (a null doc_id sorts first).  Repeated rows
are copies.  An empty table gives no rows.  ``distinct`` keeps all columns.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import removed, saved, small, table
from .texts import sliced, split_words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
DF_BITS = 20
DF_CHUNK = 1 << 12
DAMP = 0.1
SLOT_BITS = 15
#: Bands whose buckets are compared first.
FIRST = 4
#: Nodes, and shingles, of a bucket that one side of a tile holds.
CELL = 128
CELL_SHINGLES = 1 << 21
#: Bytes of vectors that are compared at a time (their features take some fifteen times as much), and numbers in a matrix.
COMPARED_BYTES = 4 << 20
MATRIX = 1 << 21
#: Shingles sampled at a time; sketches merged by one task.
CHUNK = 1 << 13
#: Bytes of text worked on at a time; shingles take about ten times as much.
SLICE_BYTES = 3 << 20
MERGE = 64

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(shingle hashes with repeats, their rows in order, the digest of each text's words)."""
    n = len(texts)
    words, row = split_words(texts)
    plain = pc.replace_substring_regex(pc.utf8_lower(words.dictionary), r"[^\pL\pN]+", "")
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, plain.to_pylist()), np.uint64, len(plain))
    some = pc.not_equal(plain, "").to_numpy(zero_copy_only=False)
    code = words.indices.to_numpy()
    full = some[code] if len(code) else np.zeros(0, bool)
    word, row = hashes[code[full]], row[full]
    count = np.bincount(row, minlength=n)
    ends = np.cumsum(count)
    data = word.tobytes()
    digests = [xxhash.xxh3_128_digest(data[8 * (e - c) : 8 * e]) for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
    out = np.zeros(max(0, len(word) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * M1 + mixed(word[i : i + len(out)])
        inside = row[k - 1 :] == row[: len(out)]
        out, at = mixed(out[inside]), row[: len(inside)][inside]
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            whole = np.array([int.from_bytes(digests[i][:8], "little") for i in short.tolist()], np.uint64)
            out, at = np.concatenate([out, whole]), np.concatenate([at, short])
            order = np.argsort(at, kind="stable")
            out, at = out[order], at[order]
    return out, at, digests


def counted(shingle: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, row) in order of rows, and how often each occurs."""
    with np.errstate(over="ignore"):
        key = mixed(shingle ^ (row.astype(np.uint64) + np.uint64(1)) * M1)
    code = pa.array(key).dictionary_encode().indices.to_numpy()
    if not len(code):
        return shingle, row, np.zeros(0, np.int64)
    tf = np.bincount(code)
    first = np.empty(len(tf), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return shingle[first], row[first], tf


def df_slot(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - DF_BITS)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Damped idf of each hashed counter: an array of fixed size, over all documents."""

    def count(batches):
        total, docs = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in sliced(batches, most=SLICE_BYTES):
            s, row, _ = shingles(batch.column("text"))
            s, row, _ = counted(s, row)
            total += np.bincount(df_slot(s), minlength=1 << DF_BITS)
            docs += len(batch)
        yield packed(TaskContext.get().partitionId(), [(c, total[c * DF_CHUNK : (c + 1) * DF_CHUNK]) for c in range(len(total) // DF_CHUNK)] + [(-1, np.array([docs]))])

    def packed(part, chunks):
        z = zstandard.ZstdCompressor(1)
        chunks = [(c, x) for c, x in chunks if x.any()]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(chunks), pa.int32()), pa.array([c for c, _ in chunks], pa.int32()), pa.array([z.compress(x.astype("<i8").tobytes()) for _, x in chunks], pa.binary())], names=["part", "chunk", "counts"])

    def unpacked(blob):
        return np.frombuffer(zstandard.decompress(blob), "<i8")

    def merge(group: pa.Table) -> pa.Table:
        total = sum(map(unpacked, group.column("counts").to_pylist()), np.int64(0))
        return pa.Table.from_batches([packed(group.column("part")[0].as_py() // MERGE, [(group.column("chunk")[0].as_py(), total)])])

    schema = "part int, chunk int, counts binary"
    partial, parts = texts.select("text").mapInArrow(count, schema), texts.rdd.getNumPartitions()
    while parts > 1:
        partial, parts = partial.groupBy("chunk", F.floor(F.col("part") / MERGE)).applyInArrow(merge, schema), -(-parts // MERGE)
    total, docs = np.zeros(1 << DF_BITS, np.int64), 0
    for r in partial.collect():  # at most 1 + 2 ** DF_BITS / DF_CHUNK rows
        if r["chunk"] < 0:
            docs = int(unpacked(bytes(r["counts"]))[0])
        else:
            total[r["chunk"] * DF_CHUNK : (r["chunk"] + 1) * DF_CHUNK] = unpacked(bytes(r["counts"]))
    return damped_idf(total, docs)


def damped_idf(counters: np.ndarray, docs: int) -> np.ndarray:
    """``counters``: documents with a shingle, summed over all shingles of the counter."""
    others = (counters.sum() - counters) / max(1, len(counters) - 1)
    df = np.clip(counters - others, 1, max(docs, 1))
    return (1 + DAMP * (np.log(docs + 1) - np.log(df + 1)) / max(np.log(docs + 1), 1e-9)).astype(np.float32)


@functools.lru_cache(maxsize=1)
def draws(hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), beta ~ U(0, 1), by slot and hash."""
    rng = np.random.default_rng(20240229)
    shape = (1 << SLOT_BITS, hashes)
    r = rng.standard_gamma(2.0, shape, np.float32)
    return r, np.log(rng.standard_gamma(2.0, shape, np.float32)), rng.random(shape, np.float32)


def samples(shingle: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, hashes: int) -> np.ndarray:
    """The consistent weighted samples of each row, as numbers of (shingle, level); 0 for rows without shingles."""
    r_, c_, b_ = draws(hashes)
    out = np.zeros((n, hashes), np.uint64)
    least = np.full((n, hashes), np.inf, np.float32)
    log = np.log(weight).astype(np.float32)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    # Whole rows up to CHUNK shingles; longer rows in parts, whose minima are compared.
    cuts = [0]
    for s in [*starts[1:].tolist(), len(row)]:
        while s - cuts[-1] > CHUNK:
            before = starts[(starts > cuts[-1]) & (starts <= cuts[-1] + CHUNK)]
            cuts.append(int(before[-1]) if len(before) else cuts[-1] + CHUNK)
    cuts.append(len(row))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        slot = (shingle[a:b] & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        r, beta = r_[slot], b_[slot]
        level = np.floor(log[a:b, None] / r + beta)
        cost = c_[slot] - r * (level - beta + 1)
        at = np.flatnonzero(np.r_[True, row[a + 1 : b] != row[a : b - 1]])
        low = np.minimum.reduceat(cost, at)
        hit, k = np.nonzero(cost == np.repeat(low, np.diff(np.r_[at, b - a]), axis=0))
        with np.errstate(over="ignore"):
            name = mixed(shingle[a:b][hit] + (level[hit, k].astype(np.int64).astype(np.uint64) * M1) + k.astype(np.uint64))
        doc = row[a:b][hit]
        better = cost[hit, k] < least[doc, k]
        # Equal costs inside a part: the least name, whatever their order.
        doc, k, name, value = doc[better], k[better], name[better], cost[hit, k][better]
        order = np.argsort(name)[::-1]
        out[doc[order], k[order]], least[doc[order], k[order]] = name[order], value[order]
    return out


def sketched(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, tie, node, size, bands): node is the 128-bit digest of the words, size the number of shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in sliced(batches, most=SLICE_BYTES):
            s, row, digests = shingles(batch.column("text"))
            size = np.bincount(row, minlength=len(batch)).astype(np.int32)
            s, row, tf = counted(s, row)
            got = samples(s, row, (1 + np.log(tf)) * shared.value[df_slot(s)], len(batch), BANDS * ROWS).reshape(len(batch), BANDS, ROWS)
            key = np.zeros((len(batch), BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(ROWS):
                    key = mixed(key * M1 + got[:, :, i] + np.arange(1, BANDS + 1, dtype=np.uint64))
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(digests, pa.binary()), pa.array(size), pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64).ravel()))], names=["doc_id", "tie", "node", "size", "bands"])

    return docs.mapInArrow(run, "doc_id long, tie long, node binary, size int, bands array<long>")


def vectors(docs: DataFrame) -> DataFrame:
    """(node, vector): sorted upper halves of the shingle hashes, with repeats."""

    def run(batches):
        for batch in sliced(batches, most=SLICE_BYTES):
            s, row, digests = shingles(batch.column("text"))
            top = (s >> np.uint64(32)).astype(np.uint32)
            cut = np.searchsorted(row, np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([np.sort(top[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["node", "vector"])

    return docs.select("text").mapInArrow(run, "node binary, vector binary")


def entries(blobs: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) of vectors.  The k-th occurrence of a shingle is a feature of its own
    that weighs what it adds to (1 + ln tf) * idf, so two texts have in common just the sum of
    the weights of common features."""
    sizes = pc.binary_length(blobs).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    s, row = np.frombuffer(b"".join(blobs.to_pylist()), np.uint32), np.repeat(np.arange(len(blobs)), sizes)
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
    adds = np.where(nth == 0, 1.0, np.log1p(nth) - np.log(np.maximum(nth, 1)))
    return row, (s.astype(np.uint64) << np.uint64(32)) | nth.astype(np.uint64), adds * idf[(s >> np.uint32(32 - DF_BITS)).astype(np.int64)]


def common_weights(row: np.ndarray, feature: np.ndarray, weight: np.ndarray, xs: np.ndarray, ys: np.ndarray, rows: int) -> np.ndarray:
    """For each two rows x and y of a tile: the weight of their common features."""
    known, code, often = np.unique(feature, return_inverse=True, return_counts=True)
    value = np.zeros(len(known))
    value[code] = weight
    shared = often > 1
    number = np.cumsum(shared) - 1
    kept = shared[code]
    row, code, value = row[kept], number[code[kept]], value[shared]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out, step = np.zeros((len(xs), len(ys))), max(1, MATRIX // max(rows, 1))
    for a in range(0, len(value), step):
        lo, hi = np.searchsorted(code, [a, a + step])
        there = np.zeros((rows, min(step, len(value) - a)))
        there[row[lo:hi], code[lo:hi] - a] = 1
        out += (there[xs] * value[a : a + step]) @ there[ys].T
    return out


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Links from the least member of each component to its others, for a matrix of links."""
    near = near | near.T
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        least = least[least]
        if (least == label).all():
            return [(int(a), b) for b, a in enumerate(label.tolist()) if a != b]
        label = least


def tile_links(tiles: pa.Table, idf: np.ndarray, similarity: float) -> pa.RecordBatch:
    """The links (a, b) between classes of each tile: rows of one tile follow one another; those
    with ``x`` are compared with those with ``y`` if their classes, ``label``, differ."""
    tiles = tiles.combine_chunks()
    row, feature, weight = entries(tiles.column("vector").combine_chunks(), idf)
    total = np.bincount(row, weight, len(tiles))
    label = tiles.column("label").to_pylist()
    x, y = (tiles.column(c).to_numpy() for c in ("x", "y"))
    starts = np.flatnonzero(changes(tiles))
    sizes = np.diff(np.r_[starts, len(tiles)])
    found: list[tuple[bytes, bytes]] = []

    # Tiles of two rows, all at once.
    tile = np.repeat(np.arange(len(starts)), sizes)
    mine = sizes[tile[row]] == 2
    t, f, w = tile[row[mine]], feature[mine], weight[mine]
    order = np.lexsort((f, t))
    t, f, w = t[order], f[order], w[order]
    again = (t[1:] == t[:-1]) & (f[1:] == f[:-1])
    both = np.bincount(t[1:][again], w[1:][again], len(starts))
    for k in np.flatnonzero(sizes == 2).tolist():
        a = int(starts[k])
        if alike(both[k], total[a], total[a + 1], similarity) and label[a] != label[a + 1]:
            found.append((min(label[a : a + 2]), max(label[a : a + 2])))

    at = np.searchsorted(row, starts)
    for k in np.flatnonzero(sizes > 2).tolist():
        a, n = int(starts[k]), int(sizes[k])
        part = slice(at[k], at[k + 1] if k + 1 < len(at) else len(row))
        xs, ys = np.flatnonzero(x[a : a + n]), np.flatnonzero(y[a : a + n])
        got = common_weights(row[part] - a, feature[part], weight[part], xs, ys, n)
        near = alike(got, total[a + xs][:, None], total[a + ys][None, :], similarity)
        names = sorted(set(label[a : a + n]))
        number = {c: i for i, c in enumerate(names)}
        own = np.array([number[c] for c in label[a : a + n]])
        i, j = np.nonzero(near)
        links = np.zeros((len(names), len(names)), bool)
        links[own[xs[i]], own[ys[j]]] = True
        found += [(names[p], names[q]) for p, q in spanning(links)]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.binary()), pa.array([p[1] for p in found], pa.binary())], names=["a", "b"])


def alike(common, a, b, similarity: float):
    return common >= similarity * (a + b - common) - 1e-9


def changes(tiles: pa.Table) -> np.ndarray:
    """Where a row is of another tile than the row before; the first one is."""
    new = np.ones(len(tiles), bool)
    if len(tiles):
        new[1:] = functools.reduce(np.logical_or, [np.diff(tiles.column(c).to_numpy()) != 0 for c in ("key", "i", "j")])
    return new


def compared(cells: DataFrame, vector: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """(a, b): links between classes.  ``cells``: key, i, j (the tile), node, label, x, y."""
    shared = cells.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.column("vector").nbytes
            if size > COMPARED_BYTES:
                tiles = pa.concat_tables(held)
                last = int(np.flatnonzero(changes(tiles))[-1])
                if last:
                    yield tile_links(tiles.slice(0, last), shared.value, similarity)
                held = [tiles.slice(last)]
                size = held[0].column("vector").nbytes
        if held and (tiles := pa.concat_tables(held)).num_rows:
            yield tile_links(tiles, shared.value, similarity)

    rows = cells.join(vector, "node").select("key", "i", "j", "node", "label", "x", "y", "vector")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").drop("node").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each linked node's component.  Each round, a node
    takes the least label of itself and its neighbours, then that label's own label."""
    links = links.filter("a <> b")
    edges = saved(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = saved(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = edges.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        near = state.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        root = state.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = saved(near.join(root, "label").select("node", F.least("label", "root").alias("label"), (F.least("label", "root") != F.col("old")).alias("moved")))
        removed(state)
        state = after.select("node", "label")
        state.saved_at = after.saved_at
        if after.filter("moved").isEmpty():
            removed(edges)
            return state


def deal(n, shingles):
    """The number of parts into which n nodes with so many shingles are dealt."""
    return F.greatest(F.ceil(n / CELL), F.ceil(shingles / CELL_SHINGLES)).cast("int")


def part_of(parts):
    """Dealt anew in each bucket: near copies whose bands all agree meet others in every band, and so end in one class."""
    return F.pmod(F.xxhash64("node", "key"), parts).cast("int")


def first_cells(member: DataFrame) -> DataFrame:
    """Each bucket of the first bands in parts, each compared with itself."""
    i = part_of(deal(F.col("n"), F.col("shingles")))
    return member.filter(F.col("band") < FIRST).select("key", i.alias("i"), F.lit(0).alias("j"), "node", F.col("node").alias("label"), F.lit(True).alias("x"), F.lit(True).alias("y"))


def later_cells(member: DataFrame, labels: DataFrame) -> DataFrame:
    """Each bucket with nodes of different classes, but those of the first bands that were compared
    as a whole: its nodes outside the largest class with all its nodes."""
    parts = deal(F.col("n"), F.col("shingles"))
    left = member.filter((F.col("band") >= FIRST) | (parts > 1)).join(labels, "node", "left").select("node", "size", "key", "n", "shingles", F.coalesce("label", "node").alias("label"))
    left = saved(left)
    by_class = left.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    top = by_class.groupBy("key").agg(F.sum("c").alias("all"), F.sum("s").alias("all_s"), F.max(F.struct("c", "label", "s")).alias("top")).filter("all > top.c")
    top = saved(top.select("key", F.col("top.label").alias("top"), (F.col("all") - F.col("top.c")).alias("rest"), (F.col("all_s") - F.col("top.s")).alias("rest_shingles")))
    rows = left.join(top, "key").withColumns({"is": deal(F.col("rest"), F.col("rest_shingles")), "js": parts, "other": F.col("label") != F.col("top")})
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    single = rows.filter("`is` = 1 and js = 1").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "label", F.col("other").alias("x"), F.lit(True).alias("y"))
    many = rows.filter("`is` > 1 or js > 1")
    x = many.filter("other").select("key", part_of(F.col("is")).alias("i"), each("js").alias("j"), "node", "label", F.lit(True).alias("x"), F.lit(False).alias("y"))
    y = many.select("key", each("is").alias("i"), part_of(F.col("js")).alias("j"), "node", "label", F.lit(False).alias("x"), F.lit(True).alias("y"))
    return single.union(x).union(y)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, tie, node, first): ``first`` is the least (doc_id, tie) of the row's class,
    ``tie`` a hash of the text as it stands."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    idf = document_frequencies(rows)
    sketch = saved(sketched(rows, idf))
    nodes = saved(sketch.groupBy("node").agg(F.min(F.struct("doc_id", "tie")).alias("least"), F.first("bands").alias("bands"), F.first("size").alias("size")))

    # Buckets of more than one node, and those nodes' vectors.
    member = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    buckets = saved(member.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).filter("n > 1"))
    member = saved(member.join(buckets, "key"))
    busy = saved(nodes.select("node", "least").join(member.select("node").distinct(), "node"))
    picked = rows.join(small(busy.select("least.doc_id", "least.tie").alias("w"), busy.count()), rows["doc_id"].eqNullSafe(F.col("w.doc_id")) & (rows["tie"] == F.col("w.tie"))).select("text")
    vector = saved(vectors(picked).dropDuplicates(["node"]))

    links = saved(compared(first_cells(member), vector, idf, similarity))
    labels = components(links)
    removed(links)
    links = saved(compared(later_cells(member, labels), vector, idf, similarity))
    roots = components(links)
    roots = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
    named = saved(busy.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")).join(roots, "label", "left").select("node", "least", F.coalesce("root", "label").alias("label")))
    first = saved(named.groupBy("label").agg(F.min("least").alias("first")))
    named = named.join(first, "label").select("node", "first")
    final = saved(nodes.select("node", "least").join(named, "node", "left").select("node", F.coalesce("first", "least").alias("first")))
    removed(nodes, buckets, member, busy, vector, links, first)
    return sketch.select("doc_id", "tie", "node").join(final, "node")


def distinct(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with all its columns: one of the rows with the least doc_id."""
    found = classes(docs, similarity)
    keys = saved(found.groupBy("doc_id", "tie").agg(F.count("*").alias("alike"), F.max((F.struct("doc_id", "tie") == F.col("first")).cast("int")).alias("stays")))
    gone = keys.filter("stays = 0").select("doc_id", "tie")
    tie = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), tie.alias("tie"))

    def on(other):
        return rows["doc_id"].eqNullSafe(other["doc_id"]) & (rows["tie"] == other["tie"])

    again = keys.filter("stays = 1 and alike > 1").select("doc_id", "tie")
    repeats, out = again.count(), rows.join(small(gone, gone.count()), on(gone), "left_anti")
    if repeats:
        once = rows.join(small(again, repeats), on(again), "left_semi").dropDuplicates(["doc_id", "tie"])
        out = out.join(small(again, repeats), on(again), "left_anti").unionByName(once)
    return out.select("row.*")


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate class: the least doc_id in it."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("first.doc_id").alias("class_id"), (F.struct("doc_id", "tie") == F.col("first")).alias("kept"))
