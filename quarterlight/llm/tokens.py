"""Exact token ids at corpus speed.

``WordEncoder(path)`` encodes Arrow batches of texts so that each text's ids
equal ``Tokenizer.encode(text, add_special_tokens=False).ids`` of the
``tokenizers`` library for that vocabulary file.

The tokenizer drops white space before its merges, so a text's ids are the
ids of its space-separated chunks, one after another.  A batch is cut into
chunks and dictionary-encoded by Arrow; only chunks met for the first time go
through the library (their letters straight to its merge model), and a gather
puts the ids of all chunks in order.  Texts that hold one of the tokenizer's
special strings are encoded whole by the library.
"""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept by one Python worker in each of two generations.
MEMO_ENTRIES = 250_000
#: Bytes of text that are cut into chunks at a time.
SLICE_BYTES = 8 << 20


def tokenizer_path(name: str = "word_bpe_49k.json", path: str | None = None) -> str:
    """The vocabulary file: ``path`` if given, else the installed public file."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def library_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class ChunkMemo(dict):
    """chunk -> id bytes, in two generations: when one is full it becomes the
    old one, and what is still met moves on to the next."""

    def __init__(self, encode, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(start, length) runs of rows that hold about ``most`` bytes each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield start, end - start
        start = end


class WordEncoder:
    #: Letters whose lower case is one letter whatever stands around them.
    LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"

    def __init__(self, path: str):
        tok = library_tokenizer(path)
        self.tok = tok
        self.specials = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")
        code = "H" if self.dtype.itemsize == 2 else "I"
        table = dict(enumerate(_byte_letters()))
        packed = [array(code, [i]).tobytes() for i in range(tok.get_vocab_size())]
        tokenize = tok.model.tokenize

        def of_word(word: str) -> bytes:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(table)
            return b"".join([packed[t.id] for t in tokenize(mapped)])

        def of_text(text: str) -> bytes:
            return array(code, tok.encode(text, add_special_tokens=False).ids).tobytes()

        self.of_text, self.words, self.chunks = of_text, ChunkMemo(of_word), ChunkMemo(of_text, MEMO_ENTRIES // 4)

    def forget(self) -> None:
        """Empties the memos."""
        for memo in (self.words, self.chunks):
            memo.clear()
            memo.old = {}

    def chunk(self, chunk: str) -> bytes:
        """The id bytes of a string without spaces and line ends."""
        if not chunk:
            return b""
        body = chunk.rstrip(",.")
        if body.isascii() and body.isalpha():
            return self.words[body.lower()] + (self.chunks[chunk[len(body) :]] if len(body) < len(chunk) else b"")
        return self.chunks[chunk]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; number of ids of each text). Null: none."""
        parts = [self._slice(texts.slice(a, n)) for a, n in slices(texts)]
        if not parts:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        special = functools.reduce(pc.or_, [pc.match_substring(texts, s) for s in self.specials], pa.scalar(False))
        if self.specials and pc.any(special).as_py():
            rows = [(np.frombuffer(self.of_text(t), self.dtype), None) if s else self._plain(pa.array([t])) for t, s in zip(texts.to_pylist(), special.to_pylist(), strict=True)]
            return np.concatenate([r[0] for r in rows]), np.array([len(r[0]) for r in rows], np.int64)
        return self._plain(texts)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        del lists
        codes, (blob, start, count) = coded.indices.to_numpy(), self._distinct(coded.dictionary)
        n = count[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        narrow = np.int32 if ends[-1] < 1 << 31 else np.int64  # one text alone can be longer than a slice
        at = np.repeat((start[codes] - ends[:-1]).astype(narrow), n)
        at += np.arange(ends[-1], dtype=narrow)
        return pa.array(blob).take(pa.array(at)).to_numpy(), np.diff(ends[offsets - offsets[0]])

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all chunks, where each chunk's start there, and how many they are."""
        body = pc.utf8_rtrim(chunks, characters=",.")
        plain = pc.match_substring_regex(body, self.LATIN).to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(body.filter(pa.array(plain))).dictionary_encode()
        words = [self.words[w] for w in low.dictionary.to_pylist()]
        tails = pc.replace_substring_regex(chunks.filter(pa.array(plain)), "^.*[^,.]", "").dictionary_encode()
        ends = [self.chunks[t] if t else b"" for t in tails.dictionary.to_pylist()]
        out = np.empty(len(chunks), object)
        out[plain] = [words[i] + ends[j] for i, j in zip(low.indices.to_pylist(), tails.indices.to_pylist(), strict=True)]
        out[~plain] = [self.chunks[c] if c else b"" for c in chunks.filter(pa.array(~plain)).to_pylist()]
        blob = np.frombuffer(b"".join(out), self.dtype)
        count = np.fromiter(map(len, out), np.int64, len(out)) // self.dtype.itemsize
        return blob, np.cumsum(count) - count, count


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    return WordEncoder(path)
