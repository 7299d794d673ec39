"""Exact deduplication with two Bloom passes.

Pass one sets ``HASHES`` bits per row in a filter of ``bits`` bits and learns
which bits were set by two rows or more: each task lists the distinct bits it
set, by segment of the filter, and each segment is merged on its own.  Pass
two keeps as *possibly repeated* only rows all of whose bits are such bits;
equal texts always are.  Only those rows shuffle; all others pass straight
through as groups of one.

The filter has 16 bits per row, up to ``MAX_BITS`` (32 MB, the most that is
ever broadcast).  Beyond 16 million rows more rows pass for possibly repeated
and shuffle; the result stays the same.

Rows: null texts are empty; texts are equal when they are after every run of
ASCII white space is one space (compared by SHA-256).  Of equal texts the row
with the least ``doc_id`` stays (nulls last; of repeated ids exactly one row).
Other columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, alone, fold, row_id, written

HASHES = 2
BITS_PER_ROW = 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
SEGMENT_BITS = 1 << 16


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, row (unique), text_sha256 and a 64-bit hash of it, written once."""
    sha = F.sha2(F.encode(F.regexp_replace(fold(), GAP, " "), "UTF-8"), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("text_sha256"), row_id(row)) \
        .select("doc_id", "text_sha256", F.xxhash64("text_sha256").alias("h"), "row")
    return written(rows, "digests")


def filter_bits(rows: int) -> int:
    """Filter size for a number of rows: a power of two within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (max(1, rows * BITS_PER_ROW) - 1).bit_length()))


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions, one row per hash function, by double hashing."""
    u = h.astype(np.int64).view(np.uint64)
    step = (u >> np.uint64(32)) | np.uint64(1)
    return np.stack([(u + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(HASHES)]).astype(np.int64)


def repeated_bits(rows: DataFrame, bits: int) -> np.ndarray:
    """Bitmap (packed) of the bits that two rows or more set."""
    segments = bits // SEGMENT_BITS

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(bits // 8, np.uint8)
        twice = np.zeros(bits // 8, np.uint8)
        for b in batches:
            p = positions(np.asarray(b.column(0)), bits)
            own = np.sort(p, axis=0)
            own[1:][own[1:] == own[:-1]] = -1        # a row counts once for a bit
            u, n = np.unique(own[own >= 0], return_counts=True)
            byte, mask = u >> 3, (1 << (u & 7)).astype(np.uint8)
            again = (n > 1) | ((once[byte] & mask) > 0)
            np.bitwise_or.at(twice, byte[again], mask[again])
            np.bitwise_or.at(once, byte, mask)
        for s in range(segments):
            part = slice(s * SEGMENT_BITS // 8, (s + 1) * SEGMENT_BITS // 8)
            if once[part].any():
                lists = [np.flatnonzero(np.unpackbits(x[part], bitorder="little")).astype("<u2").tobytes()
                         for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([lists[0]], pa.binary()),
                                                  pa.array([lists[1]], pa.binary())], names=["segment", "once", "twice"])

    def merged(key, table):
        n = np.zeros(SEGMENT_BITS, np.int64)
        for once, twice in zip(table.column("once"), table.column("twice")):
            n[np.frombuffer(once.as_py(), "<u2")] += 1
            n[np.frombuffer(twice.as_py(), "<u2")] += 2
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()),
                         "bitmap": pa.array([np.packbits(n > 1, bitorder="little").tobytes()], pa.binary())})

    # A filter of at most MAX_BITS, so at most 32 MB reach the driver.
    found = rows.select("h").mapInArrow(alone(listed), "segment int, once binary, twice binary") \
        .groupBy("segment").applyInArrow(merged, "segment int, bitmap binary").collect()
    return _assembled(found, bits)


def flag_repeats(rows: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``maybe``: false only for rows whose hash no other row has."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(repeated_bits(rows, bits))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for b in batches:
            p = positions(np.asarray(b.column("h")), bits)
            hit = ((bitmap[p >> 3] >> (p & 7)) & 1).all(axis=0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit.astype(bool))], names=[*b.schema.names, "maybe"])

    return rows.mapInArrow(alone(flag), "doc_id long, text_sha256 string, h long, row long, maybe boolean")


def member_bits(rows: DataFrame, column: str) -> np.ndarray:
    """Bloom filter (packed, at most ``MAX_BITS``) of the values of a long column."""
    bits = filter_bits(rows.count())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(positions(np.asarray(b.column(0)), bits))
            cuts = np.searchsorted(p, np.arange(0, bits + 1, SEGMENT_BITS))
            rows_ = [(s, (p[i:j] - s * SEGMENT_BITS).astype("<u2").tobytes())
                     for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_], pa.int32()), pa.array([r[1] for r in rows_], pa.binary())],
                                             names=["segment", "bits"])

    def merged(key, table):
        n = np.zeros(SEGMENT_BITS, np.uint8)
        for x in table.column("bits"):
            n[np.frombuffer(x.as_py(), "<u2")] = 1
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()),
                         "bitmap": pa.array([np.packbits(n, bitorder="little").tobytes()], pa.binary())})

    found = rows.select(column).mapInArrow(alone(listed), "segment int, bits binary") \
        .groupBy("segment").applyInArrow(merged, "segment int, bitmap binary").collect()
    return _assembled(found, bits)


def _assembled(segments, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    for s, bitmap in segments:
        out[s * SEGMENT_BITS // 8:(s + 1) * SEGMENT_BITS // 8] = np.frombuffer(bitmap, np.uint8)
    return out


def flag_members(rows: DataFrame, column: str, bitmap: np.ndarray) -> DataFrame:
    """The rows whose value may be a member (no member is missed)."""
    shared, at = rows.sparkSession.sparkContext.broadcast(bitmap), rows.columns.index(column)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            p = positions(np.asarray(b.column(at)), 8 * len(bits))
            yield b.filter(pa.array(((bits[p >> 3] >> (p & 7)) & 1).all(axis=0).astype(bool)))

    return rows.mapInArrow(alone(pick), rows.schema)


def exact_groups(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row."""
    rows = digests(docs, row)
    flagged = written(flag_repeats(rows, filter_bits(rows.count())), "flagged")
    single = flagged.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        "text_sha256", "row")
    maybe = flagged.filter("maybe").select("doc_id", "text_sha256", "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))
    groups = maybe.groupBy("text_sha256").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    several = maybe.join(groups, "text_sha256").select(
        "doc_id", F.col("first.keep_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.keep_row")).alias("kept"),
        "text_sha256", "row")
    return single.unionByName(several)
