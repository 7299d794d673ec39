"""Sparse matrices in compressed rows, built by hand on numpy arrays, and their
product by rows (Gustavson)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

STEP = 1 << 20      # entries that one step of a product expands


class Csr(NamedTuple):
    """Row ``i`` has entries ``start[i]`` to ``start[i + 1]`` of ``column`` and ``value``."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.start) - 1


def ones(lengths: np.ndarray, column: np.ndarray, width: int) -> Csr:
    """Incidence matrix: rows of the given lengths, all values 1."""
    return Csr(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), column, np.ones(len(column), np.int32), width)


def spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges ``first[i]`` to ``first[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.repeat(first - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def row_bounds(a: Csr, b: Csr) -> np.ndarray:
    """Symbolic step of a·b: entries that each row of the product expands to."""
    size = np.concatenate([[0], np.cumsum(np.diff(b.start)[a.column], dtype=np.int64)])
    return np.diff(size[a.start])


def products(a: Csr, b: Csr, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numeric step of a·b, some rows of ``a`` at a time (one at least, about
    ``step`` expanded entries): row, column and value of the product's
    entries, by row and column.

    A row of the product is the sum of the rows of ``b`` that the row of ``a``
    names, each times its value; entries of one column are merged.
    """
    ends = np.cumsum(row_bounds(a, b), dtype=np.int64)
    first, done = 0, 0
    while first < a.rows:
        last = max(first + 1, int(np.searchsorted(ends, done + step, side="right")))
        own = slice(int(a.start[first]), int(a.start[last]))
        inner = a.column[own]
        size = np.diff(b.start)[inner]
        at = spread(b.start[inner], size)
        row = np.repeat(np.repeat(np.arange(first, last), np.diff(a.start[first:last + 1])), size)
        value = np.repeat(a.value[own].astype(np.int64), size) * b.value[at]
        key = row * np.int64(b.width) + b.column[at]
        if len(key) > 1 and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if len(new):
            yield key[new] // b.width, key[new] % b.width, np.add.reduceat(value, new)
        first, done = last, int(ends[last - 1])


def product(a: Csr, b: Csr, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a·b (row, column, value)."""
    parts = list(products(a, b, step))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts))
