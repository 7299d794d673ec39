"""Token-ID output: fixed-width bit packing with block offsets.

Every id takes the minimum number of bits of the vocabulary.  Ids are packed
in blocks of ``BLOCK_IDS``; a block starts at a byte offset of the segment's
table, so one block, or one document, is read without the others.  Thirty-two
ids fill ``bits`` 32-bit words, so packing and unpacking are 32 vector steps
whatever the number of ids.

A *segment* is one self-contained byte string (header, document index, block
offsets, payload, all little-endian).  Segments are rows of a Parquet table
written by Spark, which brings commits, retries and any store; the bytes of a
row can be saved to a file and read with :class:`Segment` alone.

Inputs: null texts are empty documents (the end id only); null ids come
first; rows with the same id are ordered by text; other columns are ignored.
An empty table gives an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .encode import encoder, vocabulary_size

BLOCK_IDS = 4096            # ids of a block; a multiple of 32
SEGMENT_IDS = 1 << 19       # a segment is closed at this many ids (or after a longer document)
MAGIC = b"TKID"
HEADER = "<4sIQQQ"   # magic, bits, documents, ids, blocks


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary, at least one."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a stream of ``bits``-wide fields, padded to 32 ids."""
    rows = -(-len(ids) // 32)
    grid = np.zeros((rows, 32), np.uint64)
    grid.reshape(-1)[:len(ids)] = ids
    out = np.zeros((rows, bits + 1), np.uint64)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        field = grid[:, j] << np.uint64(shift)
        out[:, word] |= field & np.uint64(0xFFFFFFFF)
        if shift + bits > 32:
            out[:, word + 1] |= field >> np.uint64(32)
    return out[:, :bits].astype("<u4").tobytes()


def unpack(data, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed stream."""
    rows = -(-n // 32)
    words = np.frombuffer(data, "<u4", rows * bits).reshape(rows, bits).astype(np.uint64)
    grid = np.empty((rows, 32), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        field = words[:, word] >> np.uint64(shift)
        if shift + bits > 32:
            field = field | (words[:, word + 1] << np.uint64(32 - shift))
        grid[:, j] = field & mask
    return grid.reshape(-1)[:n]


def make_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One segment of whole documents."""
    n_docs, n_ids = len(doc_ids), len(ids)
    n_blocks = -(-n_ids // BLOCK_IDS)
    # Whole blocks of a multiple of 32 ids lie back to back, so one call packs all.
    payload = pack(ids, bits)
    offsets = np.minimum(np.arange(n_blocks + 1) * (BLOCK_IDS // 32 * bits * 4), len(payload))
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([
        struct.pack(HEADER, MAGIC, bits, n_docs, n_ids, n_blocks),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), null.tobytes(),
        np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes(),
        offsets.astype("<i8").tobytes(), payload])


class Segment:
    """Reader of one segment."""

    def __init__(self, data: bytes):
        magic, self.bits, self.n_docs, self.n_ids, self.n_blocks = struct.unpack_from(HEADER, data, 0)
        if magic != MAGIC:
            raise ValueError("not a token-id segment")
        self.data, at = memoryview(data), struct.calcsize(HEADER)
        self.doc_ids, at = np.frombuffer(data, "<i8", self.n_docs, at), at + 8 * self.n_docs
        self.null, at = np.frombuffer(data, np.uint8, self.n_docs, at).astype(bool), at + self.n_docs
        self.starts, at = np.frombuffer(data, "<i8", self.n_docs + 1, at), at + 8 * (self.n_docs + 1)
        self.blocks, at = np.frombuffer(data, "<i8", self.n_blocks + 1, at), at + 8 * (self.n_blocks + 1)
        self.payload = at

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``; only the blocks that hold them are unpacked."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK_IDS, (stop - 1) // BLOCK_IDS
        part = self.data[self.payload + int(self.blocks[first]):self.payload + int(self.blocks[last + 1])]
        n = min(self.n_ids, (last + 1) * BLOCK_IDS) - first * BLOCK_IDS
        return unpack(part, n, self.bits)[start - first * BLOCK_IDS:stop - first * BLOCK_IDS]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def write_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending id order into segments.

    Rows: ``part``, ``seq`` (their order is the order of ids), ``n_docs``,
    ``n_ids``, ``data``.  The documents are range-partitioned by id; each task
    encodes its range and closes a segment every ``SEGMENT_IDS`` ids.
    """
    bits = bits_for(vocabulary_size(path))

    def encode_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seq = encoder(path), TaskContext.get().partitionId(), 0

        def row(docs_, lens, ids):
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs_)], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([make_segment(docs_, lens, ids, bits)], pa.binary())],
                names=["part", "seq", "n_docs", "n_ids", "data"])

        names, lens, ids = [], np.zeros(0, np.int64), np.zeros(0, np.uint32)
        for b in batches:
            got, n = tok.encode(b.column(1), end_id)
            names, lens, ids = names + b.column(0).to_pylist(), np.concatenate([lens, n]), np.concatenate([ids, got])
            while len(ids) >= SEGMENT_IDS:
                ends = np.cumsum(lens)
                k = int(np.searchsorted(ends, SEGMENT_IDS)) + 1
                cut = int(ends[k - 1])
                yield row(names[:k], lens[:k], ids[:cut])
                names, lens, ids, seq = names[k:], lens[k:], ids[cut:], seq + 1
        if names:
            yield row(names, lens, ids)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(encode_range, "part int, seq int, n_docs long, n_ids long, data binary")
    return written(rows, "token-ids", **{"parquet.block.size": str(16 * 1024 * 1024)})


def read_index(segments: DataFrame) -> DataFrame:
    """Per document, read from the segments: ``doc_id``, ``start`` (ids of all
    documents before it), ``n_tokens``, ``ids_crc32``.

    Starts are prefix sums over segments, first of whole parts, then inside a
    part; no single task sees more than one row per part.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, data in zip(b.column(0), b.column(1), b.column(2)):
                s = Segment(data.as_py())
                ids = s.read(0, s.n_ids).astype("<u4", copy=False)
                crc = [zlib.crc32(ids[s.starts[k]:s.starts[k + 1]]) for k in range(s.n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, mask=s.null, type=pa.int64()), pa.array([part.as_py()] * s.n_docs, pa.int32()),
                     pa.array([seq.as_py()] * s.n_docs, pa.int32()), pa.array(s.starts[:-1]),
                     pa.array(np.diff(s.starts)), pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "seq", "local", "n_tokens", "ids_crc32"])

    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq")
    starts = segments.select("part", "seq", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("seq_start")) \
        .join(before, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("base"))
    return segments.select("part", "seq", "data") \
        .mapInArrow(digest, "doc_id long, part int, seq int, local long, n_tokens long, ids_crc32 long") \
        .join(starts, ["part", "seq"]) \
        .select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
