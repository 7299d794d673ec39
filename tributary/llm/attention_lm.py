"""Language-model scoring with causal self-attention over subword ids.

The model predicts subword ``t`` after the ids ``x[0..i]`` as

    p(t | x) = exp(U[x_i, t] + Z[class(t)]) / sum_c exp(Z[c]) * S[x_i, c]

``U`` are log transition probabilities between subwords, ``Z = a W`` is the
output of one causal attention head over the last ``WINDOW`` ids (``a`` is the
attention-weighted mean of value vectors), and ``S[s, c]`` sums ``exp U`` over
a class, so the softmax is over the whole vocabulary at the price of one term
per class.  Queries, keys, values, position weights and ``W`` are trained in
numpy by Adam.  A text is scored in windows of ``WINDOW`` ids that overlap by
``WINDOW - STRIDE``; each id is scored once, in the window that gives it most
context, with one batched masked attention for all windows of a batch.

What is gathered from the corpus covers all training documents: the count of
every word, and from these the counts of subwords, of subword pairs inside
words, and of first and last subwords; and the count of every pair of a word's
last and the next word's first subword.  The attention head is trained on all
of them too, each id once: in ``ROUNDS`` rounds, each over its share of the
windows, every shard of ``TRAIN_DOCS`` training texts takes Adam steps from
the same weights, and the mean of the shards' weights, by their numbers of
windows, starts the next round.  The sums are of whole numbers, so they do not
depend on the order of tasks.  The model has at most ``IDS`` ids of its own;
rarer ids share one and are told apart by their counts.

Texts are split into words once; each block of texts lists its distinct words.
A word is counted and encoded once for the whole corpus and its count and ids
go back to the blocks that have it, so neither word counts nor texts are ever
broadcast; texts themselves do not shuffle, their word codes do, once, to meet
their words' ids.  What comes of it, one row of model ids a block, is written;
training and scoring read it without a shuffle.

Rows: a null text is empty (its end token is scored); repeated rows get equal
results and each counts; a null doc_id counts for training; without training
documents all counts are zero and the model is uniform over the vocabulary;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_store, written
from .encode import encoder, vocabulary_size
from .words import coded_words, doc_of

IDS = 2048              # ids of the model
CLASSES = 32
WIDTH = 8               # of queries, keys and values
WINDOW = 16
STRIDE = 12
TRAIN_DOCS = 1500       # training texts of one shard
ROUNDS = 2
BATCH = 512             # windows of an Adam step
STEPS = 400
BLOCK_BYTES = 10 * 1024 * 1024
SMOOTHING = 5.0         # weight of the subword frequencies in a transition row
BUCKET_WORDS = 300_000  # blocks' entries of words that are encoded together, on average
EDGE = 0xFFFFFFFF       # in pairs of subwords: the start and the end of a word
CROSS_SMOOTHING = 50.0  # weight of the corpus's first subwords in a row between words


# ---- packed arrays ---------------------------------------------------------

def packed(x: np.ndarray) -> bytes:
    """The numbers by bytes of equal rank (most upper bytes are zero), compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes), "zstd", asbytes=True)


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    """What :func:`packed` made of numbers of this kind."""
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(memoryview(raw)[8:], n * width, "zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def ascending(raw: bytes) -> np.ndarray:
    """Ascending codes from their packed differences."""
    return np.cumsum(unpacked(raw, "<u4"), dtype=np.int64)


def joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


# ---- corpus counts ---------------------------------------------------------

def word_blocks(docs: DataFrame, held_out) -> DataFrame:
    """One row per block of texts: block, doc_id, held, bounds and codes
    (packed), words (most frequent first), counts in training texts."""

    def block(key: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        names, codes, bounds = coded_words(pa.concat_arrays(t.column(1).chunks) if t.column(1).num_chunks != 1 else t.column(1).chunk(0))
        held = np.array(t.column(2).to_pylist(), bool)
        order = np.argsort(-np.bincount(codes, minlength=len(names)), kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        codes = rank[codes].astype(np.uint32)
        train = np.bincount(codes[~held[doc_of(bounds)]], minlength=len(names))
        return pa.RecordBatch.from_arrays(
            [pa.array([key]), pa.array([t.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())),
             pa.array([packed(bounds.astype("<i8"))], pa.binary()), pa.array([packed(codes.astype("<u4"))], pa.binary()),
             pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.take(pa.array(order)).cast(pa.string())),
             pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.array(train, pa.int64()))],
            names=["block", "doc_id", "held", "bounds", "codes", "words", "counts"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, parts, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for b in batches:
            parts.append(b)
            size += b.nbytes
            if size >= BLOCK_BYTES:
                yield block(first + n, parts)
                n, parts, size = n + 1, [], 0
        if size:
            yield block(first + n, parts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held"))
    return written(rows.mapInArrow(split, "block long, doc_id array<long>, held array<boolean>, bounds binary, codes binary, "
                                          "words array<string>, counts array<long>"), "word-blocks", compression="zstd")


def counted_words(blocks: DataFrame, path: str) -> DataFrame:
    """Count and encode every word once for the corpus.

    Each block deals its distinct words to buckets by hash, packed into one
    row per bucket; a bucket then holds every block's entries of its words.
    The number of buckets follows the number of entries, so a bucket's memory
    does not grow with the corpus, and rows are never more than entries.
    Rows with a block: ``codes`` (differences), ``counts``, ``lengths``,
    ``ids`` (of ``width`` bytes) of that block's words in the bucket, packed.  One row per bucket without a block:
    ``total`` and ``words`` (in training texts), ``pairs`` and ``pair_counts``
    (see :func:`pair_counts`).
    """
    buckets = max(1, -(-(blocks.agg(F.sum(F.size("words"))).first()[0] or 0) // BUCKET_WORDS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                names = words.values
                where = (pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)).astype(np.int64) \
                    if len(names) else np.zeros(0, np.int64)
                order = np.argsort(where, kind="stable")
                counts = np.asarray(counts.values)[order]
                names = names.take(pa.array(order)).to_pylist()
                cuts = np.searchsorted(where[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    part = slice(int(cuts[k]), int(cuts[k + 1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([block]), pa.array([packed(np.frombuffer("\n".join(names[part]).encode(), np.uint8))], pa.binary()),
                         pa.array([packed(np.diff(order[part], prepend=0).astype("<u4"))], pa.binary()),
                         pa.array([packed(counts[part].astype("<i8"))], pa.binary())],
                        names=["bucket", "block", "names", "codes", "counts"])

    def gather(key, table):
        names = [unpacked(x, "u1").tobytes().decode().split("\n") for x in table.column("names").to_pylist()]
        size = np.array([len(x) for x in names], np.int64)
        coded = pa.array(itertools.chain.from_iterable(names), pa.string(), size=int(size.sum())).dictionary_encode()
        del names
        at = np.asarray(coded.indices)
        n = np.bincount(at, np.concatenate([unpacked(x, "<i8") for x in table.column("counts").to_pylist()]), len(coded.dictionary)).astype(np.int64)
        ids, lens = encoder(path).encode_distinct(coded.dictionary.to_pylist())
        start = np.cumsum(lens) - lens
        pairs, times = pair_counts(ids, lens, n)
        rows = {"block": [None], "codes": [None], "counts": [None], "lengths": [None], "ids": [None], "width": [None], "total": [int(n.sum())],
                "words": [int((n > 0).sum())], "pairs": [pairs.tobytes()], "pair_counts": [times.tobytes()]}
        first = 0
        for block, codes, k in zip(table.column("block").to_pylist(), table.column("codes").to_pylist(), size.tolist()):
            mine = at[first:first + k]
            first += k
            own = lens[mine]
            flat = ids[np.repeat(start[mine] - np.cumsum(own) + own, own) + np.arange(own.sum())]
            width = 2 if flat.max(initial=0) < 1 << 16 else 4
            for f, x in (("block", block), ("codes", codes), ("counts", packed(n[mine].astype("<i8"))), ("lengths", packed(own.astype("<u4"))),
                         ("ids", packed(flat.astype(f"<u{width}"))), ("width", width), ("total", None),
                         ("words", None), ("pairs", None), ("pair_counts", None)):
                rows[f].append(x)
        kinds = {"block": pa.int64(), "width": pa.int32(), "total": pa.int64(), "words": pa.int64()}
        return pa.table({f: pa.array(x, kinds.get(f, pa.binary())) for f, x in rows.items()})

    dealt = blocks.select("block", "words", "counts").mapInArrow(deal, "bucket int, block long, names binary, codes binary, counts binary")
    return written(dealt.groupBy("bucket").applyInArrow(
        gather, "block long, codes binary, counts binary, lengths binary, ids binary, width int, total long, words long, pairs binary, pair_counts binary"),
        "words", compression="zstd", **{"parquet.block.size": str(16 * 1024 * 1024)})


def block_words(entries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's words, from all buckets, in the order of their codes: that
    order, the number of ids of each, and the ids."""
    codes = joined([ascending(x) for x in entries.column("codes").to_pylist()], "<i8")
    lens = joined([unpacked(x, "<u4") for x in entries.column("lengths").to_pylist()], "<u4")
    ids = [unpacked(x, f"<u{w}") for x, w in zip(entries.column("ids").to_pylist(), entries.column("width").to_pylist())]
    ids = joined(ids, "<u4").astype(np.int32)
    lens, order = lens.astype(np.int64), np.argsort(codes)
    start, per = (np.cumsum(lens) - lens)[order], lens[order]
    return order, per, ids[np.repeat(start - np.cumsum(per) + per, per) + np.arange(per.sum())]


def pair_counts(ids: np.ndarray, lens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (first id * 2^32 + second id) of subwords next to each other in
    words of the training texts, and how often.  The id 2^32 - 1 stands for
    the start and for the end of a word."""
    edge = np.array([EDGE], np.uint64)
    flat, some, ends = ids.astype(np.uint64), lens > 0, np.cumsum(lens)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([edge, flat[:-1]])
    before[(ends - lens)[some]] = edge
    pairs = np.concatenate([(before << np.uint64(32)) | flat, (flat[(ends - 1)[some]] << np.uint64(32)) | edge]).view(np.int64)
    u, at = np.unique(pairs, return_inverse=True)
    total = np.bincount(at, np.concatenate([np.repeat(n, lens), n[some]])).astype(np.int64)
    return u[total > 0], total[total > 0]


def _unpacked(words: DataFrame, make, schema: str) -> DataFrame:
    """``make(pairs, counts)``, two arrays, of every bucket's pairs."""
    first, second = schema.split()[0], schema.split()[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pairs, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                u, total = make(np.frombuffer(pairs, "<i8"), np.frombuffer(n, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(total, pa.int64())], names=[first, second])

    return words.filter("block is null").select("pairs", "pair_counts").mapInArrow(run, schema)


def subword_counts(pairs: np.ndarray, n: np.ndarray, vocabulary: int) -> np.ndarray:
    """How often each subword occurs."""
    second = pairs.view(np.uint64) & np.uint64(EDGE)
    return np.bincount(second[second != EDGE].astype(np.int64), n[second != EDGE], vocabulary)


def model_pairs(pairs: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Pairs of subwords as first * (size + 1) + second in model ids; ``size``
    stands for the start and for the end of a word."""
    size = int(number[-1]) + 1
    a, b = (pairs.view(np.uint64) >> np.uint64(32)).astype(np.int64), (pairs.view(np.uint64) & np.uint64(EDGE)).astype(np.int64)
    # the edge, as a position, is past the vocabulary's
    table = np.append(number[:-1], size)
    return table[np.minimum(a, len(table) - 1)] * (size + 1) + table[np.minimum(b, len(table) - 1)]


def corpus_subwords(words: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each subword occurs in words of the training texts."""
    def count(pairs, n):
        total = subword_counts(pairs, n, vocabulary).astype(np.int64)
        return np.flatnonzero(total), total[total > 0]

    rows = _unpacked(words, count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocabulary)
    out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return out


def corpus_pairs(words: DataFrame, number: np.ndarray) -> np.ndarray:
    """Counts of the training texts' pairs inside words, by model ids; pairs
    are mapped before they are summed, so rows are at most the model's ids squared."""
    shared, size = words.sparkSession.sparkContext.broadcast(number), int(number[-1]) + 1

    def count(pairs, n):
        u, at = np.unique(model_pairs(pairs, shared.value), return_inverse=True)
        return u, np.bincount(at, n, len(u)).astype(np.int64)

    rows = _unpacked(words, count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size + 1) ** 2)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out


def block_codes(blocks: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and word codes of the texts of block ``i``."""
    return unpacked(blocks.column("bounds")[i].as_py(), "<i8"), unpacked(blocks.column("codes")[i].as_py(), "<u4").view(np.int32)


def between_words(bounds: np.ndarray, codes: np.ndarray, held: np.ndarray, lens: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Last model id of a word and first of the next one, for all words of the
    training texts; the end id stands before and after a text."""
    some, ends = lens > 0, np.cumsum(lens)
    first, last = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
    first[some], last[some] = ids[(ends - lens)[some]], ids[(ends - 1)[some]]
    doc = doc_of(bounds)
    keep = some[codes] & ~held[doc]
    codes, n = codes[keep], np.bincount(doc[keep], minlength=len(held))[~held]
    cuts = np.cumsum(n)
    return np.insert(last[codes], cuts - n, end), np.insert(first[codes], cuts, end)


def text_streams(blocks: DataFrame, words: DataFrame, number: np.ndarray, spread: np.ndarray, base) -> DataFrame:
    """One row per block: of its texts ``doc_id``, ``held``, number of words,
    known words, base score and log10 of the rare ids' shares, and packed the
    number of model ids of each (with the end's) and these ids; and packed the
    pairs between words of its training texts, and how often."""
    shared, size = blocks.sparkSession.sparkContext.broadcast((number, spread)), int(number[-1]) + 1
    width = 2 if size <= 1 << 16 else 4

    def make(left, right):
        number, spread = shared.value
        order, lens, ids = block_words(right)
        counts = joined([unpacked(x, "<i8") for x in right.column("counts").to_pylist()], "<i8")[order]
        own = number[ids].astype(f"<u{width}")
        rare = np.concatenate([[0.0], np.cumsum(spread[ids])])
        start = np.cumsum(lens) - lens
        rare = rare[start + lens] - rare[start]
        rows = []
        for i in range(left.num_rows):
            bounds, codes = block_codes(left, i)
            held = np.array(left.column("held")[i].as_py(), bool)
            a, b = between_words(bounds, codes, held, lens, own.astype(np.int64), size - 1)
            a *= size
            a += b
            total = np.bincount(a, minlength=size * size)
            del a, b
            pair = np.flatnonzero(total)
            known, score, shares, lengths, stream = block_stream(bounds, codes, counts, lens, own, rare, base, size - 1)
            rows.append((left.column("block")[i].as_py(), left.column("doc_id")[i].as_py(), held.tolist(), np.diff(bounds).tolist(), known.tolist(),
                         score.tolist(), shares.tolist(), packed(lengths.astype("<i8")), packed(stream), packed(pair.astype("<i8")), packed(total[pair].astype("<i8"))))
        names = ("block", "doc_id", "held", "n", "known", "base", "rare", "lengths", "ids", "pairs", "pair_counts")
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()),
                 pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({f: pa.array([r[k] for r in rows], kind) for k, (f, kind) in enumerate(zip(names, kinds))})

    texts = blocks.select("block", "doc_id", "held", "bounds", "codes")
    entries = words.filter("block is not null").select(F.col("block").alias("of"), "codes", "counts", "lengths", "ids", "width")
    return written(texts.groupBy("block").cogroup(entries.groupBy("of")).applyInArrow(
        make, "block long, doc_id array<long>, held array<boolean>, n array<long>, known array<long>, base array<double>, rare array<double>, "
              "lengths binary, ids binary, pairs binary, pair_counts binary"), "streams", compression="zstd", **{"parquet.block.size": str(16 * 1024 * 1024)})


def block_stream(bounds, codes, counts, lens, own, rare, base, end: int, slice_words: int = 300_000):
    """Known words, base score and the rare ids' part of each text of a block,
    the number of its ids (with the end's) and the ids; texts are taken in
    slices of bounded size."""
    k = len(bounds) - 1
    start = np.cumsum(lens) - lens
    known, score, shares, lengths, streams = np.zeros(k, np.int64), np.zeros(k), np.zeros(k), np.zeros(k, np.int64), []
    first = 0
    while first < k:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + slice_words, side="right")) - 1)
        mine, cut = codes[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first]
        doc = doc_of(cut)
        part = slice(first, last)
        known[part] = np.bincount(doc, counts[mine] > 0, last - first)
        score[part] = np.bincount(doc, base(counts)[mine] if len(counts) < len(mine) else base(counts[mine]), last - first)
        shares[part] = np.bincount(doc, rare[mine], last - first)
        per = lens[mine]
        sums = np.concatenate([[0], np.cumsum(per)])
        lengths[part] = sums[cut[1:]] - sums[cut[:-1]] + 1
        stream = own[np.repeat(start[mine] - sums[:-1], per) + np.arange(sums[-1])]
        streams.append(np.insert(stream, sums[cut[1:]], end))
        first = last
    return known, score, shares, lengths, joined(streams, own.dtype)


def corpus_crossings(streams: DataFrame, size: int) -> np.ndarray:
    """Counts of the training texts' pairs between words, by model ids."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pairs, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(pairs, "<i8")), pa.array(unpacked(n, "<i8"))], names=["pair", "n"])

    rows = streams.select("pairs", "pair_counts").mapInArrow(read, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(size, size)


# ---- the model -------------------------------------------------------------

class Model:
    """Transitions, classes and the attention head."""

    FIELDS = ("number", "spread", "u", "s", "cls", "q", "k", "v", "w", "bias")

    def __init__(self, **arrays):
        for f in self.FIELDS:
            setattr(self, f, arrays[f])

    def state(self) -> dict:
        return {f: getattr(self, f) for f in self.FIELDS}

    def attention(self, x: np.ndarray):
        """Weights and outputs of the head for windows ``x`` (batch, length)."""
        n = x.shape[1]
        lag = np.arange(n)[:, None] - np.arange(n)[None, :]
        mask = np.where(lag >= 0, self.bias[np.clip(lag, 0, len(self.bias) - 1)], np.float32(-1e9)).astype(np.float32)
        e = np.matmul(self.q.take(x, axis=0), self.k.take(x, axis=0).transpose(0, 2, 1))
        e += mask
        np.minimum(e, np.float32(30.0), out=e)
        np.exp(e, out=e)
        total = (e.reshape(-1, n) @ np.ones(n, np.float32)).reshape(*x.shape, 1)
        out = np.matmul(e, self.v.take(x, axis=0))
        out /= total
        return e, total, out

    def log10(self, x: np.ndarray, y: np.ndarray, first: int) -> np.ndarray:
        """log10 p(y) after each position of ``x`` from ``first`` on (flat)."""
        a = self.attention(x)[2][:, first:].reshape(-1, WIDTH)
        s, t = x[:, first:].reshape(-1), y[:, first:].reshape(-1)
        z = a @ self.w
        own = z[np.arange(len(t)), self.cls.take(t)] + self.u.reshape(-1).take(s.astype(np.int64) * self.u.shape[1] + t)
        np.exp(z, out=z)
        z *= self.s.take(s, axis=0)
        return (own - np.log(z @ np.ones(CLASSES, np.float32))) / np.float32(np.log(10.0))


def windows(lengths: np.ndarray, stride: int = STRIDE, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of ``lengths`` positions: text, first position, and
    the first position scored, counted inside the window.  The first window of
    a text scores all its positions; each later one its last ``stride``."""
    more = np.maximum(0, -(-(lengths - size) // stride))
    count = np.where(lengths > 0, more + 1, 0)
    text = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return text, nth * stride, np.where(nth > 0, size - stride, 0)


def score(model: Model, ids: np.ndarray, lengths: np.ndarray, rows: int = 4096) -> np.ndarray:
    """log10 probability of each text; ``ids`` are model ids, every text
    followed by the end id, which is also what stands before a text."""
    end = model.number[-1]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    before = np.concatenate([ids[:1], ids[:-1]])
    before[bounds[:-1]] = end
    out = np.zeros(len(lengths))
    text, start, scored = windows(lengths)
    span = np.arange(WINDOW)
    for first in np.unique(scored):
        mine = np.flatnonzero(scored == first)
        for part in np.array_split(mine, max(1, -(-len(mine) // rows))):
            if not len(part):
                continue
            t, at = text[part], start[part]
            left = np.minimum(WINDOW, lengths[t] - at)
            pos = bounds[t][:, None] + at[:, None] + np.minimum(span, left[:, None] - 1)
            p = model.log10(before.take(pos), ids.take(pos), int(first)).reshape(len(part), -1)
            p *= span[first:] < left[:, None]
            out += np.bincount(t, p.sum(axis=1, dtype=np.float64), len(lengths))
    return out


def _classes(p: np.ndarray, uni: np.ndarray, rng) -> np.ndarray:
    """k-means of the ids by the square roots of what comes before and after
    them, in a random projection."""
    n = len(uni)
    joint = np.sqrt(p * uni[:, None])
    side = rng.standard_normal((n, 24)).astype(np.float32)
    x = np.concatenate([joint @ side, joint.T @ side], axis=1)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centre = x[np.argsort(-uni, kind="stable")[:CLASSES]].copy()
    for _ in range(12):
        cls = (x @ centre.T).argmax(axis=1)
        for c in range(len(centre)):
            if (cls == c).any():
                centre[c] = (x[cls == c] * uni[cls == c, None]).sum(axis=0)
                centre[c] /= np.linalg.norm(centre[c]) + 1e-9
    return cls.astype(np.int64)


def model_numbers(count: np.ndarray, end_id: int) -> np.ndarray:
    """Model id of every subword, and the end's: 0 for rare subwords, then the
    most frequent ones; the end id is always one of them."""
    order = np.lexsort((np.arange(len(count)), -count))
    kept = [int(i) for i in order[:IDS - 2] if count[i] > 0 and i != end_id]
    number = np.zeros(len(count) + 1, np.int64)
    number[kept] = np.arange(1, len(kept) + 1)
    number[end_id] = number[-1] = len(kept) + 1
    return number


def rare_shares(number: np.ndarray, count: np.ndarray) -> np.ndarray:
    """log10 of each rare subword's share of the id that they have in common; 0 for the others."""
    rare = number[:-1] == 0
    spread = np.zeros(len(count))
    spread[rare] = np.log10((count[rare] + 0.5) / (count[rare] + 0.5).sum())
    return spread


def fit(pairs: list[tuple], sample: list[np.ndarray], vocabulary: int, end_id: int, steps: int = STEPS) -> Model:
    """Model from subword pair counts (arrays pair, n) and texts (ids) that are
    the whole corpus."""
    pair, n = np.asarray(pairs[0], np.int64), np.asarray(pairs[1], float)
    count = subword_counts(pair, n, vocabulary)
    count[end_id] += len(sample) or 1
    number = model_numbers(count, end_id)
    size = int(number[-1]) + 1
    inner = np.bincount(model_pairs(pair, number), n, (size + 1) ** 2)
    # between words is what the texts' pairs have beyond those inside words
    cross = np.zeros((size, size))
    for x in sample:
        m = np.concatenate([[size - 1], number[x]])
        np.add.at(cross, (m[:-1], m[1:]), 1.0)
    c, last = inner.reshape(size + 1, size + 1)[:size, :size], inner.reshape(size + 1, size + 1)[:size, size]
    scale = cross.sum(axis=1) / np.maximum(c.sum(axis=1) + last, 1.0)
    return fit_counts(number, count, inner, np.maximum(cross - c * scale[:, None], 0), len(sample), sample, steps)


def fit_counts(number: np.ndarray, count: np.ndarray, inner: np.ndarray, cross: np.ndarray, ends: int, sample: list[np.ndarray],
               steps: int = STEPS) -> Model:
    """Model from counts of subwords and (by model ids) of pairs inside and
    between words, the number of texts, and sample texts (ids)."""
    rng = np.random.default_rng(7)
    end = int(number[-1])
    size = end + 1
    spread = rare_shares(number, count)
    uni = np.bincount(number[:-1], count, size) + 0.5
    uni /= uni.sum()

    inner = inner.reshape(size + 1, size + 1)
    c, last = inner[:size, :size], inner[:size, size].copy()
    first = inner[size, :size] + 0.5 * uni
    first = first / first.sum()
    last[end] = max(last[end], ends, 1)
    # transitions between words are smoothed by the corpus's first subwords
    q = (cross + CROSS_SMOOTHING * first) / (cross.sum(axis=1, keepdims=True) + CROSS_SMOOTHING)
    p = c + last[:, None] * q
    p = (p + SMOOTHING * uni) / (p.sum(axis=1, keepdims=True) + SMOOTHING)

    cls = _classes(p, uni, rng)
    s = np.stack([p[:, cls == k].sum(axis=1) for k in range(CLASSES)], axis=1)
    small = lambda *shape: (0.3 * rng.standard_normal(shape)).astype(np.float32)
    model = Model(number=number, spread=spread, u=np.log(p).astype(np.float32), s=s.astype(np.float32), cls=cls,
                  q=small(size, WIDTH), k=small(size, WIDTH), v=small(size, WIDTH), w=np.zeros((WIDTH, CLASSES), np.float32),
                  bias=np.zeros(WINDOW, np.float32))
    stream = [np.concatenate([[end], number[x]]) for x in sample if len(x) > 1]
    if stream and steps:
        train(model, stream, steps, rng)
    return model


def train(model: Model, texts: list[np.ndarray], steps: int, rng, batch: int = 256, rate: float = 0.02) -> None:
    """Adam on the log-likelihood of random windows of the texts; the weights
    that do best on every tenth text, which is not trained on, are kept."""
    check = texts[::10] if len(texts) >= 20 else texts
    texts = [t for k, t in enumerate(texts) if k % 10] if len(texts) >= 20 else texts
    check_ids = np.concatenate([t[1:] for t in check])
    check_lengths = np.array([len(t) - 1 for t in check])
    best_score, best = -np.inf, None
    flat = np.concatenate(texts)
    ok = np.ones(len(flat), bool)
    ends = np.cumsum([len(t) for t in texts])
    for k in range(1, WINDOW + 1):
        ok[ends - k] = False        # a window and its targets stay inside one text
    starts = np.flatnonzero(ok)
    if not len(starts):
        return
    adam = Adam(model)
    for step in range(1, steps + 1):
        at = rng.choice(starts, batch)[:, None] + np.arange(WINDOW + 1)
        adam.step(flat[at[:, :-1]], flat[at[:, 1:]], None, rate * min(1.0, 3.0 * (1.0 - step / (steps + 1.0))))
        if step % 50 == 0 or step == steps:
            now = score(model, check_ids, check_lengths).sum()
            if now > best_score:
                best_score, best = now, {f: p.copy() for f, p in adam.params.items()}
    for f, p in best.items():
        setattr(model, f, p)


class Adam:
    """Steps on the weights of a model's head, in place."""

    HEAD = ("q", "k", "v", "w", "bias")

    def __init__(self, model: Model):
        self.model, self.n = model, 0
        self.params = {f: getattr(model, f) for f in self.HEAD}
        self.first = {f: np.zeros_like(x) for f, x in self.params.items()}
        self.second = {f: np.zeros_like(x) for f, x in self.params.items()}
        self.lag = np.clip(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0, None).reshape(-1)

    def gradient(self, x: np.ndarray, y: np.ndarray, inside: np.ndarray | None) -> dict[str, np.ndarray]:
        """Of the mean log-likelihood of ``y`` after ``x``, at the places ``inside`` a text (all, if None)."""
        model, at = self.model, x.reshape(-1)
        q, k, v = (getattr(model, f).take(x, axis=0) for f in "qkv")
        weight, total, a = model.attention(x)
        weight /= total
        a = a.reshape(-1, WIDTH)
        dz = a @ model.w
        np.exp(dz, out=dz)
        dz *= model.s.take(at, axis=0)
        # each place's part of the mean; less the probabilities of the classes, and the one that came
        part = np.full(at.size, 1.0 / at.size, np.float32) if inside is None else inside.reshape(-1) / np.float32(inside.sum())
        dz *= (-part / (dz @ np.ones(dz.shape[1], np.float32)))[:, None]
        dz[np.arange(at.size), model.cls.take(y.reshape(-1))] += part
        da = dz @ model.w.T
        # the weighted mean of a row's scores is that of its values
        mean = np.einsum("ij,ij->i", da, a).reshape(*x.shape, 1)
        da = da.reshape(*x.shape, WIDTH)
        dscore = np.matmul(da, v.transpose(0, 2, 1))
        dscore -= mean
        dscore *= weight
        rows = np.empty((*x.shape, 3 * WIDTH), np.float32)
        rows[:, :, :WIDTH] = np.matmul(dscore, k)
        rows[:, :, WIDTH:2 * WIDTH] = np.matmul(dscore.transpose(0, 2, 1), q)
        rows[:, :, 2 * WIDTH:] = np.matmul(weight.transpose(0, 2, 1), da)
        # the rows of one id are neighbours once sorted (small numbers sort by their digits)
        order = np.argsort(at.astype(np.uint16) if len(model.q) <= 1 << 16 else at, kind="stable")
        at = at.take(order)
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        sums = np.zeros((len(model.q), 3 * WIDTH), np.float32)
        sums[at[heads]] = np.add.reduceat(rows.reshape(-1, 3 * WIDTH).take(order, axis=0), heads, axis=0)
        return {"q": sums[:, :WIDTH], "k": sums[:, WIDTH:2 * WIDTH], "v": sums[:, 2 * WIDTH:],
                "w": a.T @ dz,
                "bias": np.bincount(self.lag, dscore.sum(axis=0).reshape(-1), WINDOW).astype(np.float32)}

    def step(self, x: np.ndarray, y: np.ndarray, inside: np.ndarray | None, pace: float) -> None:
        self.n += 1
        pace, fix1, fix2 = np.float32(pace / (1 - 0.9 ** self.n)), np.float32(0.1), np.float32(1 / (1 - 0.99 ** self.n))
        for f, d in self.gradient(x, y, inside).items():
            first, second = self.first[f], self.second[f]
            first += fix1 * (d - first)
            second += np.float32(0.01) * (d * d - second)
            self.params[f] += pace * first / (np.sqrt(second * fix2) + np.float32(1e-6))


def train_shard(model: Model, ids: np.ndarray, lengths: np.ndarray, turn: int, rounds: int, rate: float = 0.02) -> int:
    """Adam steps on round ``turn``'s share of the windows of the texts (ids,
    each text with its end): every ``rounds``-th in a fixed random order, each
    id in one window.  Returns the number of windows."""
    count = -(-lengths // WINDOW)
    text = np.repeat(np.arange(len(lengths)), count)
    order = np.random.default_rng(7).permutation(len(text))[turn::rounds]
    if not len(order):
        return 0
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    starts = np.cumsum(lengths) - lengths
    before = np.concatenate([ids[:1], ids[:-1]])
    before[starts] = model.number[-1]
    first, left = (starts[text] + nth * WINDOW)[order], np.minimum(WINDOW, lengths[text] - nth * WINDOW)[order]
    adam, span, steps = Adam(model), np.arange(WINDOW), -(-len(order) // BATCH)
    for step in range(steps):
        part = slice(step * BATCH, (step + 1) * BATCH)
        at = first[part, None] + np.minimum(span, left[part, None] - 1)
        done = (turn + (step + 1) / (steps + 1)) / rounds
        adam.step(before.take(at), ids.take(at), span < left[part, None], rate * min(1.0, 3.0 * (1.0 - done)))
    return len(order)


def train_corpus(model: Model, streams: DataFrame, rounds: int = ROUNDS) -> None:
    """Train the head on all training texts of the blocks."""
    shapes = {f: getattr(model, f).shape for f in Adam.HEAD}
    size = sum(int(np.prod(s)) for s in shapes.values())
    for turn in range(rounds):
        shared = streams.sparkSession.sparkContext.broadcast(model.state())

        def run(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            # weights times windows, as whole numbers; the last entry counts windows
            total = np.zeros(size + 1, np.int64)
            for b in batches:
                for doc, held, lengths, ids in zip(*(b.column(k).to_pylist() for k in range(4))):
                    lengths, ids = unpacked(lengths, "<i8"), unpacked(ids, "<u2" if len(shared.value["q"]) <= 1 << 16 else "<u4")
                    # by doc_id, so the order of a block's rows does not matter
                    order = np.array(sorted((k for k in range(len(held)) if not held[k]), key=lambda k: (doc[k] is None, doc[k] or 0)), np.int64)
                    start, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
                    ids = ids[np.repeat(start - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())].astype(np.int32)
                    ends = np.concatenate([[0], np.cumsum(lengths)])
                    for k in range(0, len(lengths), TRAIN_DOCS):
                        mine = slice(k, k + TRAIN_DOCS)
                        own = Model(**shared.value | {f: shared.value[f].copy() for f in Adam.HEAD})
                        n = train_shard(own, ids[ends[k]:ends[min(k + TRAIN_DOCS, len(lengths))]], lengths[mine], turn, rounds)
                        if n:
                            flat = np.concatenate([getattr(own, f).reshape(-1) for f in Adam.HEAD]).astype(np.float64)
                            total[:-1] += np.rint(flat * (n * 2.0 ** 20)).astype(np.int64)
                            total[-1] += n
            if total[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(total)], names=["i", "total"])

        rows = streams.select("doc_id", "held", "lengths", "ids").mapInArrow(run, "i int, total long").groupBy("i").agg(F.sum("total").alias("total")).toArrow()
        shared.unpersist()
        if not rows.num_rows:
            return
        total = np.zeros(size + 1)
        total[rows.column("i").to_numpy()] = rows.column("total").to_numpy()
        flat = (total[:-1] / (total[-1] * 2.0 ** 20)).astype(np.float32)
        cut = 0
        for f, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(model, f, flat[cut:cut + n].reshape(shape).copy())
            cut += n


# ---- scoring ---------------------------------------------------------------

def score_documents(docs: DataFrame, held_out, path: str, end_id: int) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    spark = docs.sparkSession
    vocabulary = vocabulary_size(path)
    blocks = word_blocks(docs, held_out)
    words = counted_words(blocks, path)
    n, v = words.filter("block is null").agg(F.sum("total"), F.sum("words")).first()
    ends = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    n, v = (n or 0) + ends, (v or 0) + (ends > 0)
    count = corpus_subwords(words, vocabulary)
    count[end_id] += ends or 1
    number = model_numbers(count, end_id)

    def base(c):
        return np.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    streams = text_streams(blocks, words, number, rare_shares(number, count), base)
    model = fit_counts(number, count, corpus_pairs(words, number), corpus_crossings(streams, int(number[-1]) + 1), ends, [])
    train_corpus(model, streams)
    shared, key = spark.sparkContext.broadcast(model.state()), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("attention")
        if key not in store:
            store.clear()
            store[key] = Model(**shared.value)
        kind = "<u2" if len(store[key].q) <= 1 << 16 else "<u4"
        for b in batches:
            for i in range(b.num_rows):
                doc, held, count, known, plain, rare, lengths, ids = (b.column(k).slice(i, 1) for k in range(8))
                total = score(store[key], unpacked(ids[0].as_py(), kind).astype(np.int32), unpacked(lengths[0].as_py(), "<i8")) + rare.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [doc.flatten(), held.flatten(), pa.array(count.flatten().to_numpy() + 1), pa.array(known.flatten().to_numpy() + (ends > 0)),
                     pa.array([n] * len(total), pa.int64()), pa.array(plain.flatten().to_numpy() + base(ends)), pa.array(total)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return streams.select("doc_id", "held", "n", "known", "base", "rare", "lengths", "ids").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
