"""Words of a batch of texts as codes into the batch's distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def plain(texts: pa.Array) -> pa.Array:
    """Texts as large strings in an array of their own, null as empty.

    The copy matters: string kernels misread arrays that are slices of others.
    """
    texts = texts.cast(pa.large_string())
    return pc.if_else(pc.is_valid(texts), texts, pa.scalar("", pa.large_string()))


def coded_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (Arrow strings), the code of every word in text order,
    and bounds: text ``i`` has codes ``bounds[i]`` to ``bounds[i + 1]``.

    Words are maximal runs without ASCII white space; ``lower`` maps A-Z to
    a-z and nothing else.  Null texts have no words.
    """
    texts = plain(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(1, np.int64)
    lists = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    keep = pc.not_equal(flat, "")       # texts that start or end with white space give empty pieces
    kept = np.asarray(keep)
    if not kept.all():
        bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
        flat = flat.filter(keep)
    coded = flat.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), bounds


def doc_of(bounds: np.ndarray) -> np.ndarray:
    """Text number of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def text_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes, or of one text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    first, done = 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield first, last
        first, done = last, int(ends[last - 1])


class WordTable:
    """A worker's cache of one small vector per word, cleared when full."""

    def __init__(self, compute, width: int, dtype, capacity: int = 400_000):
        self.compute, self.width, self.dtype, self.capacity = compute, width, dtype, capacity
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width), self.dtype)

    def lookup(self, names: list[str]) -> np.ndarray:
        """One row per name."""
        if len(self.slot) + len(names) > self.capacity:
            self.clear()
        fresh = [w for w in names if w not in self.slot]
        if fresh:
            first, n = len(self.slot), len(fresh)
            if first + n > len(self.rows):
                self.rows = np.resize(self.rows, (max(first + n, 2 * len(self.rows)), self.width))
            self.rows[first:first + n] = self.compute(fresh)
            self.slot.update(zip(fresh, range(first, first + n)))
        at = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))
        return self.rows[at]
