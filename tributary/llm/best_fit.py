"""Best-fit packing: best-fit decreasing into sequences of a fixed capacity.

Documents are encoded, cut into pieces only when longer than the capacity,
and the pieces (a few numbers each, no ids) are dealt to groups of about
``GROUP_PIECES``.  Each group is packed by best-fit decreasing: a segment tree
over the remaining capacities finds the tightest open sequence that still
holds a piece in logarithmic time.  A group leaves at most about one sequence
part empty, so the number of sequences stays near the lower bound.

Inputs: null texts are empty documents (the end id only); rows with equal ids
or texts are packed as rows of their own; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .encode import encoder

CAPACITY = 4096
GROUP_PIECES = 50_000


class OpenBins:
    """Open sequences by remaining capacity: a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, bin_: int) -> None:
        self.bins[remaining].append(bin_)
        k = remaining + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (remaining, sequence) with the least remaining
        capacity that is at least ``need``."""
        k = need + self.size
        if not self.count[k]:
            while k and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if not k:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        remaining = k - self.size
        while k:
            self.count[k] -= 1
            k >>= 1
        return remaining, self.bins[remaining].pop()


def best_fit_decreasing(lengths, capacity: int = CAPACITY) -> tuple[list[int], list[int], int]:
    """Sequence number and offset of each piece, for lengths in descending
    order, and the number of sequences."""
    tree, at, offsets, n = OpenBins(capacity), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            remaining, bin_, n = capacity, n, n + 1
        else:
            remaining, bin_ = found
        at.append(bin_)
        offsets.append(capacity - remaining)
        if remaining > length:
            tree.add(remaining - length, bin_)
    return at, offsets, n


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Encoded pieces: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        for b in batches:
            ids, lens = tok.encode(b.column(1), end_id)
            ids = ids.astype("<u4", copy=False)
            n = -(-lens // capacity)
            doc = np.repeat(np.arange(len(lens)), n)
            piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, lens[doc] - start)
            first = (np.cumsum(lens) - lens)[doc] + start
            crc = [zlib.crc32(ids[a:a + k]) for a, k in zip(first.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                 pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, length, ...)."""
    groups = max(1, -(-rows.count() // GROUP_PIECES))

    def place(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True],
                              kind="stable", ignore_index=True)
        at, offsets, _ = best_fit_decreasing(pdf["length"].tolist(), capacity)
        return pdf.assign(sequence_id=np.array(at, np.int64) + (int(key[0]) << 40), offset=np.array(offsets, np.int64)) \
            .drop(columns=["pack_group"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("pack_group")
    return rows.select("*", group).groupBy("pack_group") \
        .applyInPandas(place, f"{schema}, sequence_id long, offset long")


def best_fit(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pack whole documents; returns one row per piece."""
    return pack_pieces(written(pieces(docs, path, end_id, capacity), "pieces"), capacity)
