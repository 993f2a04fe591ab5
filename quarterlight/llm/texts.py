"""Arrow and numpy helpers over batches of whole texts."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of text that are worked on at a time hold about this many bytes.
SLICE_BYTES = 6 << 20


def give_back() -> None:
    """Returns free memory to the system: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def sliced(batches, column: str = "text", most: int = SLICE_BYTES):
    """Cuts record batches into parts whose texts hold about ``most`` bytes."""
    from .tokens import slices

    for batch in batches:
        for a, n in slices(batch.column(column), most):
            yield batch.slice(a, n)
        give_back()


def flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All items, and the row that each belongs to."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes.astype(np.int64))


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words (runs of characters other than the six ASCII white-space ones), dictionary-coded, and their rows."""
    words, row = flat(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
    some = pc.not_equal(words, "")
    return words.filter(some).dictionary_encode(), row[some.to_numpy(zero_copy_only=False)]


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums by row."""
    return np.bincount(row, weights, n).astype(np.int64)


def codes_of(values: np.ndarray) -> np.ndarray:
    """Small whole numbers that are equal where ``values`` are."""
    return pa.array(values).dictionary_encode().indices.to_numpy()
