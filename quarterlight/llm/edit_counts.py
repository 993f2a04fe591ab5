"""Token counts that follow edits.

A document is kept as a tree over pre-token segments: leaves are runs of whole
segments (about LEAF characters), and two binary indexed trees hold the subtree sums of
characters and tokens.  Leaves begin after white space or where the tokenizer is bound to
begin a new pre-token, in any script: between a letter or digit and a punctuation mark (ASCII but for JOINED, and the usual ones of other
scripts), and on both sides of an ASCII digit that has a letter or digit beside it.  An edit finds its leaves by descent and re-encodes them
alone; the boundary context is the rest of these leaves, and the neighbour that the edit touches.  Their stored
count is taken off, so nothing old is encoded again.  Leaves that grow are cut again.

``edited_counts`` can return the leaves with their counts (``keep``) and take them in place of a text
(``leaves``), so that a later round of edits encodes no text that did not change.

Edits are (start, end, replacement) in characters of the document as the earlier
edits left it; ends outside are clipped, an end before its start deletes nothing, a
null replacement is empty, a null edit changes nothing.  Null text is empty; null
edits are none; repeated rows count alike; an empty table gives no rows.  A document's
edits are applied one after another, so they are held together with it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .texts import sliced
from .tokens import tokenizer_path, word_encoder

LEAF = 128
SPACE = re.compile("[ \n]")
#: Marks that can belong to the letters beside them: contractions and special tokens.
JOINED = "'<>|"
_MARK = "".join(re.escape(c) for c in [*map(chr, range(33, 127)), *"¡¿«»—–…“”„、。，！？；：「」『』（）《》〈〉【】〔〕・～"] if not c.isalnum() and c not in JOINED)
#: Where a leaf can begin.
CUT = re.compile(rf"(?<=[ \n])|(?<=[^\W_])(?=[0-9{_MARK}])|(?<=[0-9])(?=[^\W_])|(?<=[{_MARK}])(?=[^\W_])")
EDIT = "struct<start:long,end:long,replacement:string>"
SCHEMA = "doc_id long, n_tokens long, versions array<long>, n_leaves int, n_chars long, encoded_chars long"
LEAVES = "array<struct<text:string,tokens:long>>"
#: What the query's edits put in.
INSERTS = ("", "x", " and", "token ", " \n", "é", "2024", "...")


class Sums:
    """A binary indexed tree: prefix sums, updates and descent in logarithmic time."""

    def __init__(self, values: list[int]):
        self.tree = [0, *values]
        self.top = 1 << (len(values).bit_length() - 1) if values else 0
        for i in range(1, len(self.tree)):
            if (j := i + (i & -i)) < len(self.tree):
                self.tree[j] += self.tree[i]

    def add(self, at: int, change: int) -> None:
        at += 1
        while at < len(self.tree):
            self.tree[at] += change
            at += at & -at

    def before(self, at: int) -> int:
        out = 0
        while at:
            out += self.tree[at]
            at -= at & -at
        return out

    def find(self, value: int) -> tuple[int, int]:
        """(the leaf in which ``value`` lies, the sum before it)."""
        at, done, step = 0, 0, self.top
        while step:
            if at + step < len(self.tree) and done + self.tree[at + step] <= value:
                at += step
                done += self.tree[at]
            step >>= 1
        return at, done


def leaves_of(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = CUT.search(text, at + LEAF)
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out or [""]


class CountTree:
    """A document's leaves with their subtree sums; ``count`` gives a string's number of tokens."""

    def __init__(self, leaves: list[str], tokens: list[int], count):
        self.leaves, self.tokens, self.count = leaves, tokens, count
        self.char_sums, self.token_sums = Sums([len(x) for x in leaves]), Sums(tokens)
        self.n_chars, self.n_tokens, self.encoded = sum(map(len, leaves)), sum(tokens), 0

    def put(self, at: int, text: str, tokens: int) -> None:
        self.char_sums.add(at, len(text) - len(self.leaves[at]))
        self.token_sums.add(at, tokens - self.tokens[at])
        self.leaves[at], self.tokens[at] = text, tokens

    def edit(self, start: int, end: int, replacement: str) -> None:
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        first, base = self.char_sums.find(start)
        if first == len(self.leaves):
            first -= 1
            base = self.char_sums.before(first)
        before = first - 1
        while before > 0 and not self.leaves[before]:
            before -= 1
        if start == base and before >= 0 and self.leaves[before] and self.leaves[before][-1] not in " \n":
            first, base = before, base - len(self.leaves[before])  # the edit touches the leaf before
        last, text, tokens = first, self.leaves[first], self.tokens[first]
        while end - base >= len(text) and last + 1 < len(self.leaves):  # so the last character stays
            last += 1
            text, tokens = text + self.leaves[last], tokens + self.tokens[last]
        new = text[: start - base] + replacement + text[end - base :]
        now = self.count(new)
        self.encoded += len(new)
        self.n_chars += len(new) - len(text)
        self.n_tokens += now - tokens
        if len(new) > 8 * LEAF and len(parts := leaves_of(new)) > 1:
            self.encoded += len(new)
            self.leaves[first : last + 1], self.tokens[first : last + 1] = parts, [self.count(x) for x in parts]
            self.char_sums, self.token_sums = Sums([len(x) for x in self.leaves]), Sums(self.tokens)
            return
        for k in range(first + 1, last + 1):
            self.put(k, "", 0)
        self.put(first, new, now)


def edited_counts(docs: DataFrame, tokenizer: str | None = None, leaves: str | None = None, keep: bool = False) -> DataFrame:
    """``docs`` with doc_id, text and edits (an array of structs): the tokens of the
    text as it stands, after each edit, and how many characters were encoded for all edits.
    ``leaves`` names a column of kept leaves that stands for the text; ``keep`` returns the leaves."""
    path = tokenizer_path(path=tokenizer)

    def run(batches):
        encoder = word_encoder(path)

        def count(text: str) -> int:
            return sum(len(encoder.chunk(c)) for c in SPACE.split(text)) // encoder.dtype.itemsize

        def trees(batch):
            if leaves:
                kept = [d or [{"text": "", "tokens": 0}] for d in batch.column("leaves").to_pylist()]
                return [CountTree([x["text"] for x in d], [x["tokens"] for x in d], count) for d in kept]
            cut = [leaves_of(t or "") for t in batch.column("text").to_pylist()]
            sizes = np.cumsum([0, *map(len, cut)])
            tokens = encoder.encode(pa.array([x for d in cut for x in d], pa.string()))[1].tolist()
            return [CountTree(d, tokens[sizes[i] : sizes[i + 1]], count) for i, d in enumerate(cut)]

        for batch in batches if leaves else sliced(batches):
            rows = []
            for tree, edits in zip(trees(batch), batch.column("edits").to_pylist(), strict=True):
                first, versions, n_leaves = tree.n_tokens, [], len(tree.leaves)
                for e in edits or []:
                    if e is not None and e["start"] is not None:
                        tree.edit(e["start"], e["end"] if e["end"] is not None else e["start"], e["replacement"] or "")
                    versions.append(tree.n_tokens)
                held = [{"text": x, "tokens": n} for x, n in zip(tree.leaves, tree.tokens, strict=True) if x] if keep else None
                rows.append((first, versions, n_leaves, tree.n_chars, tree.encoded, held))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int64())])))
            names = ["doc_id", "n_tokens", "versions", "n_leaves", "n_chars", "encoded_chars", "leaves"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]][: 6 + keep], names=names[: 6 + keep])

    text = F.col(leaves).cast(LEAVES).alias("leaves") if leaves else F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.col("edits").cast(f"array<{EDIT}>")).mapInArrow(run, SCHEMA + (f", leaves {LEAVES}" if keep else ""))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text, edits): each document with its rows of ``edits`` (doc_id, number, start,
    end, replacement) in order of ``number``."""
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "start", "end", "replacement"))).alias("edits"))
    listed = listed.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["replacement"].cast("string").alias("replacement"))))
    return docs.select("doc_id", "text").join(listed, "doc_id", "left")


def drawn_edits(edits: int = 4):
    """An edit script drawn from a row's doc_id and text length: deletions, insertions and replacements."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")

    def one(k: int):
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{k}")).cast("binary"))
        start = h % (size + 1)
        return F.struct(start.alias("start"), (start + F.floor(h / 7).cast("long") % 24).alias("end"), F.element_at(F.array(*map(F.lit, INSERTS)), (F.floor(h / 31) % len(INSERTS) + 1).cast("int")).alias("replacement"))

    return F.array(*[one(k) for k in range(edits)])


def op3_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: tokens before and after each edit of a drawn script."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", drawn_edits())
    return edited_counts(docs).withColumn("n_tokens_edited", F.element_at("versions", -1)).drop("versions")
