"""Media columns: interleaved document sequences.

A page becomes one ordered sequence of structs: its texts and its media
references, as they stand, each reference with its caption.  Payloads live in a
media store, a table of (digest, format, media) in which equal payloads share a
digest; references are resolved by a join on the digest, and positions and
captions stay with the reference.

Store form: a payload is padded with zero bytes to a positive multiple of WIDTH
and stored as an 8-bit grey PNG of WIDTH columns, which is lossless.

Media are shown by <img>, <video>, <audio>, <source>, <embed> and <object>; a
reference is "media:sha256/<hex>", any other address has a null digest and stays
unresolved.  The caption is the <figcaption> of the reference's figure, at any depth there: the
next one after it, else the last before it; without one its alt or title text, else empty.  A
<figcaption> of a figure without media is text.  Null html is an empty sequence, null payload an
empty one.  Repeated references resolve each time; a digest that is missing in the
store leaves nulls.  Other columns of pages are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .html import BLOCKS, RAW, Node, parse
from .texts import sliced

WIDTH = 64
LEVEL = 2
PNG = b"\x89PNG\r\n\x1a\n"
SHOWS = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src", "object": "data"}
REFERENCE = re.compile(r"media:sha256/([0-9a-f]{64})")
SEQUENCE = "page_id long, items array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
ITEM = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image of WIDTH columns; the payload must fill its rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` wrote, checked."""
    if image[:8] != PNG:
        raise ValueError("not a PNG image")
    at, data, shape = 8, [], None
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("damaged PNG image")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if shape[2:] != (8, 0, 0, 0, 0) or lines[:, 0].any():
        raise ValueError("not an 8-bit grey image without filters")
    return lines[:, 1:].tobytes()


def padded(payload: bytes) -> bytes:
    return payload + bytes(max(1, -(-len(payload) // WIDTH)) * WIDTH - len(payload))


def digest_of(payload: Column) -> Column:
    """The store's digest of a binary payload, padded as the store pads it."""
    size = F.octet_length(payload)
    zeros = F.when(size == 0, WIDTH).otherwise((-size) % WIDTH + F.when((-size) % WIDTH < 0, WIDTH).otherwise(0))
    return F.sha2(F.concat(payload, F.substring(F.lit(bytes(WIDTH)), F.lit(1), zeros.cast("int"))), 256)


def media_store(payloads: DataFrame) -> DataFrame:
    """(digest, format, media): the stored form of each distinct payload of a task; a digest
    that several tasks meet has equal rows, of which readers take one."""

    def run(batches):
        seen = set()
        for batch in sliced(batches, "payload"):
            digests, media = [], []
            for p in batch.column("payload").to_pylist():
                full = padded(p or b"")
                d = hashlib.sha256(full).digest()
                if d not in seen:
                    seen.add(d)
                    digests.append(d.hex())
                    media.append(to_png(full))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(["png"] * len(media), pa.string()), pa.array(media, pa.binary())], names=["digest", "format", "media"])

    return saved(payloads.select(F.col("payload").cast("binary")).mapInArrow(run, "digest string, format string, media binary"))


def features(store: DataFrame) -> DataFrame:
    """What is read back from the stored bytes, one row a digest: payload and media sizes and
    hashes, the checksum of the payload's last 64 bytes, and as feature the mean, deviation and
    entropy of the samples and a 64-bit average hash of the image scaled to 8 x 8."""

    def run(batches):
        for batch in batches:
            out = []
            for d, m in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
                p = from_png(m)
                x = np.frombuffer(p, np.uint8)
                share = np.bincount(x, minlength=256) / len(x)
                entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
                rows = np.array_split(np.arange(len(x) // WIDTH), 8)
                image = x.reshape(-1, WIDTH).astype(np.float64)
                cells = np.array([image[r].reshape(-1, 8, WIDTH // 8).mean(axis=(0, 2)) if len(r) else np.zeros(8) for r in rows])
                bits = int.from_bytes(np.packbits(cells > cells.mean()).tobytes())
                out.append((d, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), f"{x.mean():.4f};{x.std():.4f};{entropy:.4f};{bits:016x}"))
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    read = store.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.dropDuplicates(["digest"])


def items_of(html: str | None) -> list[dict]:
    """The page's texts and media references, in order."""
    items: list[dict] = []
    pending: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(pending).split()):
            items.append({"position": len(items), "kind": "text", "text": text, "digest": None, "caption": None})
        pending.clear()

    def plain(node: Node) -> str:
        out, todo = [], [node]
        while todo:
            n = todo.pop()
            out.append(n.text if n.tag == "#" else " " if n.tag in BLOCKS or n.tag == "br" else "")
            todo += reversed(n.children)
        return "".join(out)

    def below(node: Node) -> list[Node]:
        """The media and captions of a figure, in order, without those of figures inside."""
        out, todo = [], list(reversed(node.children))
        while todo:
            c = todo.pop()
            if c.tag in SHOWS and c.attrs.get(SHOWS[c.tag]) or c.tag == "figcaption":
                out.append(c)
            if c.tag not in RAW and c.tag not in ("figcaption", "figure"):
                todo += reversed(c.children)
        return out

    captions: dict[int, str] = {}  # of media, by their figure's caption
    spent: set[int] = set()  # captions that belong to media

    def assign(figure: Node) -> None:
        """Each medium takes the next caption after it, else the last one before it."""
        found = below(figure)
        media = [c for c in found if c.tag != "figcaption"]
        marks = [k for k, c in enumerate(found) if c.tag == "figcaption"]
        if media and marks:
            for k, c in enumerate(found):
                if c.tag == "figcaption":
                    spent.add(id(c))
                else:
                    captions[id(c)] = plain(found[next((m for m in marks if m > k), marks[-1])])

    def caption_of(node: Node) -> str:
        return " ".join((captions.get(id(node)) or node.attrs.get("alt") or node.attrs.get("title") or "").split())

    todo = [(parse(html), False)]
    while todo:
        node, done = todo.pop()
        if node.tag == "figure" and not done:
            assign(node)
        if done:
            flush()
        elif node.tag == "#":
            pending.append(node.text)
        elif node.tag in SHOWS and node.attrs.get(SHOWS[node.tag]):
            flush()
            found = REFERENCE.fullmatch(node.attrs[SHOWS[node.tag]].strip())
            items.append({"position": len(items), "kind": "media", "text": None, "digest": found[1] if found else None, "caption": caption_of(node)})
        elif node.tag not in RAW and id(node) not in spent:
            if node.tag in BLOCKS or node.tag == "br":
                flush()
                todo.append((node, True))
            todo += [(c, False) for c in reversed(node.children)]
    flush()
    return items


def sequences(pages: DataFrame) -> DataFrame:
    """(page_id, items): one ordered sequence of text and media structs for each page."""

    def run(batches):
        for batch in sliced(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([items_of(h) for h in batch.column("html").to_pylist()], ITEM)], names=["page_id", "items"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, SEQUENCE)


def resolved(sequence: DataFrame, described: DataFrame) -> DataFrame:
    """One row for each item, media with the columns that ``described`` has for their digest."""
    rows = sequence.select("page_id", F.explode("items").alias("item")).select("page_id", "item.*")
    return rows.join(described, "digest", "left")


def op2_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as media, referenced from a page of its own and read back from the store."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("payload"))
    described = saved(features(media_store(docs)))  # so that Spark can split the digest of a large group of copies
    size = F.octet_length("payload").cast("string")
    page = F.concat(F.lit('<figure><img src="media:sha256/'), digest_of(F.col("payload")), F.lit('"><figcaption>'), size, F.lit("</figcaption></figure>"))
    items = resolved(sequences(docs.select(F.col("doc_id").alias("page_id"), page.alias("html"))), described).filter("kind = 'media'")
    return items.select(F.col("page_id").alias("doc_id"), F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
