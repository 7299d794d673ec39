"""Divergence of a language's sources by iceberg prefix refinement.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased.  A
language keeps the terms that ``least`` of its documents have.  They are found
by their byte prefixes: level by level prefixes get twice as long, each with
the number of distinct documents that hold it.  A prefix of fewer than
``least`` documents is discarded, and so no longer prefix of its terms is ever
listed or shuffled; a prefix that reaches the end of its term (a zero byte,
which no term holds) is a complete kept term.  Levels end when no longer
prefix is left.

Texts are cut into terms once: a packed row per block of documents holds the
block's sorted distinct terms and each document's terms and counts.  A block
deals its counts to buckets by hash, packed into one row per bucket, and each
bucket sums those of all blocks; buckets grow in number with the blocks' terms,
not in size.  The
prefixes that survive a level are sent to the next as a Bloom filter of a
bounded size (32 MB at most): it may let a rare prefix pass, whose count then
discards it, but loses none.

For a group (language, source) or a language, a kept term has the share
``p = 1 + floor(10^9 (n + 1) / (N + V))``: n its count there, N the sum of
counts over kept terms, V the number of kept terms.  The divergence of p from
q is ``floor((p - q)^2 / q)``.  Pairs of sources sum it over all kept terms;
only terms that both sources have are joined, the others follow from each
source's own distribution of shares.  All sums are exact.

Rows: null text, language and source are ''; texts without terms (null and
empty ones too) count for nothing but make their group occur; very long texts
and terms are read whole; repeated rows are documents of their own; ties have
the lesser term or source first (by bytes); other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .csr import spread
from .exact_dedup import member_bits, positions
from .ngram_join import mix
from .words import plain, text_slices

LEAST = 3               # documents that a kept term is in
TOP = 200               # ranks of part ``term``
SCALE = 1_000_000_000
FIRST_LEVEL = 4         # bytes of the first level's prefixes
BLOCK_BYTES = 8 << 20   # text of one block (a longer text is a block of its own)
BUCKET_TERMS = 200_000  # blocks' distinct terms whose counts are summed together, on average

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_TERM = np.zeros(256, bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Sorted distinct terms (binary) of the texts, the term of every
    occurrence in text order, and bounds per text."""
    texts = plain(texts)
    offsets = np.asarray(pc.binary_length(texts)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(offsets)])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[:offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    inside = IN_TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = inside[edges]        # a term ends where its text does
    starts = np.flatnonzero(first)
    letters = LOWER[data[inside]]
    at = np.append(np.cumsum(inside)[starts] - 1, len(letters)).astype(np.int64) if len(starts) else np.zeros(1, np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[np.asarray(coded.indices)], np.searchsorted(starts, offsets)


BLOCK = "langs array<string>, sources array<string>, terms binary, term_sizes binary, doc_sizes binary, doc_group binary, " \
    "term_of binary, times binary"


def blocks(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """A packed row per block of documents, written once: its groups, its
    sorted distinct terms, and per document its group, terms and counts."""
    def pack(lang: pa.Array, source: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        names, code, bounds = terms_of(texts)
        n, width = len(texts), max(1, len(names))
        cell, times = np.unique(np.repeat(np.arange(n), np.diff(bounds)) * np.int64(width) + code, return_counts=True)
        group = pa.StructArray.from_arrays([lang, source], names=["lang", "source"]).to_pylist()
        numbers: dict[tuple, int] = {}
        of = np.array([numbers.setdefault((g["lang"], g["source"]), len(numbers)) for g in group], "<u4")
        binary = [b"".join(names.to_pylist()), np.asarray(pc.binary_length(names)).astype("<u4").tobytes(),
                  np.bincount(cell // width, minlength=n).astype("<u4").tobytes(), of.tobytes(),
                  (cell % width).astype("<u4").tobytes(), times.astype("<u4").tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([[g[0] for g in numbers]]), pa.array([[g[1] for g in numbers]]), *[pa.array([x], pa.binary()) for x in binary]],
            names=[f.split()[0] for f in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in text_slices(b.column(2), limit):
                yield pack(*[b.column(k).slice(i, j - i) for k in range(3)])

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return written(rows.mapInArrow(run, BLOCK), "divergence-blocks", compression="zstd")


def salts(langs: list[str]) -> np.ndarray:
    """A number for each language, to be mixed with hashes of its prefixes."""
    return mix(pd.util.hash_array(np.array(langs, object), categorize=False) + np.uint64(1))


def byte_hash(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes (none is empty): the sum of its bytes (plus
    one, so that the zero byte counts) times a random weight of their place."""
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    weight = mix(np.arange(1, int(size.max()) + 1, dtype=np.uint64))
    return np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * weight[np.arange(len(data)) - np.repeat(first, size)], first)


def byte_runs(names: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, one after the other, and bounds."""
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset:names.offset + len(names) + 1] if len(names) else np.zeros(1, np.int64)
    data = np.frombuffer(names.buffers()[2], np.uint8) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


class Block:
    """A packed row read back; ``pair`` names the (language, term) pairs of
    the block, in order of language and term."""

    def __init__(self, row: dict):
        self.langs, self.sources = row["langs"], row["sources"]
        size = np.frombuffer(row["term_sizes"], "<u4").astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum(size)])
        # every term ends in a zero byte
        data = np.zeros(int(self.ends[-1]) + len(size), np.uint8)
        inner = np.ones(len(data), bool)
        inner[self.ends[1:] + np.arange(len(size))] = False
        data[inner] = np.frombuffer(row["terms"], np.uint8)
        self.data, self.size, self.start = data, size + 1, self.ends[:-1] + np.arange(len(size))
        per = np.frombuffer(row["doc_sizes"], "<u4")
        self.doc = np.repeat(np.arange(len(per)), per)
        self.group = np.frombuffer(row["doc_group"], "<u4")[self.doc]
        self.term, self.times = np.frombuffer(row["term_of"], "<u4").astype(np.int64), np.frombuffer(row["times"], "<u4")
        self.names = sorted(set(self.langs))
        self.lang_of_group = np.array([self.names.index(x) for x in self.langs], np.int64)
        self.lang = self.lang_of_group[self.group]
        self.salt = salts(self.names)

    def prefixes(self, length: int, terms: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Of some terms (ascending): the number of each one's prefix, and the
        distinct prefixes."""
        size = np.minimum(self.size[terms], length)
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(terms), [
            None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(self.data[spread(self.start[terms], size)])])
        coded = out.dictionary_encode()
        return np.asarray(coded.indices).astype(np.int64), coded.dictionary

    def prefix_hash(self, length: int, terms: np.ndarray) -> np.ndarray:
        """A hash of each term's prefix."""
        size = np.minimum(self.size[terms], length)
        return byte_hash(self.data[spread(self.start[terms], size)], size)

    def hashes(self, lang: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return mix(self.salt[lang] ^ prefix).view(np.int64)


def is_member(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = positions(h, 8 * len(bitmap))
    return ((bitmap[p >> 3] >> (p & 7)) & 1).all(axis=0).astype(bool)


DEALT = "bucket long, langs array<string>, sources array<string>, items binary, sizes binary, of binary, n binary"


def bucket_count(packed: DataFrame) -> int:
    """Buckets for the blocks' distinct terms."""
    terms = packed.agg(F.sum(F.length("term_sizes"))).first()[0] or 0
    return max(1, -(-terms // (4 * BUCKET_TERMS)))


def dealt(buckets: int, langs: list[str], sources: list[str], of: np.ndarray, names: pa.LargeBinaryArray, item: np.ndarray,
          h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A block's entries (number of the group, item among the names, hash,
    count) by buckets of the hash, a packed row for each."""
    bucket = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    data, ends = byte_runs(names.take(pa.array(item[order])))
    of, n, sizes = of[order].astype("<u4"), n[order].astype("<i8"), np.diff(ends).astype("<u4")
    some, first = np.unique(bucket[order], return_index=True)
    cuts = list(zip(first.tolist(), np.append(first[1:], len(order)).tolist()))
    parts = [[data[ends[i]:ends[j]].tobytes() for i, j in cuts], *[[x[i:j].tobytes() for i, j in cuts] for x in (sizes, of, n)]]
    groups = [pa.array([x] * len(cuts), pa.list_(pa.string())) for x in (langs, sources)]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *groups, *[pa.array(x, pa.binary()) for x in parts]],
                                      names=[f.split()[0] for f in DEALT.split(", ")])


def summed(rows: DataFrame, least: int) -> DataFrame:
    """lang, source, item, h, n: sums of dealt entries that reach ``least``."""
    def add(key: tuple, table: pa.Table) -> pa.Table:
        numbers: dict[tuple, int] = {}
        of = [np.array([numbers.setdefault(g, len(numbers)) for g in zip(langs, sources)], np.int64)[np.frombuffer(x, "<u4")]
              for langs, sources, x in zip(*[table.column(f).to_pylist() for f in ("langs", "sources", "of")])]
        sizes, n = [np.frombuffer(b"".join(table.column(f).to_pylist()), kind).astype(np.int64) for f, kind in (("sizes", "<u4"), ("n", "<i8"))]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [
            None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(b"".join(table.column("items").to_pylist()))]).dictionary_encode()
        names, width = coded.dictionary, len(coded.dictionary)
        cell, at = np.unique(np.concatenate(of) * width + np.asarray(coded.indices), return_inverse=True)
        total = np.bincount(at, n).astype(np.int64)
        cell, total = cell[total >= least], total[total >= least]
        group, item = cell // width, cell % width
        data, ends = byte_runs(names)
        langs, sources = [[g[k] for g in numbers] for k in range(2)]
        h = mix(salts(langs)[group] ^ byte_hash(data, np.diff(ends))[item]).view(np.int64)
        sides = [pa.array(x, pa.string()).take(pa.array(group)) for x in (langs, sources)]
        return pa.table([*sides, names.take(pa.array(item)).cast(pa.binary()), pa.array(h), pa.array(total)], ["lang", "source", "item", "h", "n"])

    return rows.groupBy("bucket").applyInArrow(add, "lang string, source string, item binary, h long, n long")


def level(packed: DataFrame, length: int, before: int, survivors: np.ndarray | None, least: int, buckets: int = 1) -> DataFrame:
    """lang, prefix, h, n: prefixes of this length (shorter ones at the end of
    their term) that extend a survivor of the level before and are in
    ``least`` documents."""
    shared = packed.sparkSession.sparkContext.broadcast(survivors)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = Block(batch.slice(i, 1).to_pylist()[0])
                use = x.size[x.term] > before       # not complete yet
                if shared.value is not None:
                    terms = np.flatnonzero(x.size > before)
                    hashed = np.zeros(len(x.size), np.uint64)
                    hashed[terms] = x.prefix_hash(before, terms)
                    alive = np.zeros((len(x.names), len(x.size)), bool)
                    for k in range(len(x.names)):
                        alive[k, terms] = is_member(shared.value, x.hashes(np.full(len(terms), k), hashed[terms]))
                    use &= alive[x.lang, x.term]
                if not use.any():
                    continue
                terms = np.unique(x.term[use])
                (code, names), hashed = x.prefixes(length, terms), x.prefix_hash(length, terms)
                number, by_code = np.zeros(len(x.size), np.int64), np.zeros(len(names), np.uint64)
                number[terms], by_code[code] = code, hashed
                # terms ascend within a document, and so do their prefixes: equal ones are neighbours
                doc, lang, item = x.doc[use], x.lang[use], number[x.term[use]]
                new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))
                cell, n = np.unique(lang[new] * len(names) + item[new], return_counts=True)
                lang, item = cell // len(names), cell % len(names)
                yield dealt(buckets, x.names, [""] * len(x.names), lang, names, item, x.hashes(lang, by_code[item]), n)

    found = summed(packed.mapInArrow(count, DEALT), least)
    return written(found.select("lang", F.col("item").alias("prefix"), "h", "n"), "divergence-level")


def kept_terms(packed: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, h (hash of both), n (documents): by prefix refinement."""
    out, before, length, survivors, buckets = None, 0, FIRST_LEVEL, None, bucket_count(packed)
    whole = F.expr("substring(prefix, -1, 1) = X'00'")
    while True:
        found = level(packed, length, before, survivors, least, buckets)
        done = found.filter(whole).select("lang", F.expr("substring(prefix, 1, length(prefix) - 1)").cast("string").alias("term"), "h", "n")
        out = done if out is None else out.unionByName(done)
        longer = found.filter(~whole)
        if longer.isEmpty():
            return out
        survivors, before, length = member_bits(longer, "h"), length, 2 * length


def term_counts(packed: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, term, n: occurrences of the kept terms by group."""
    shared, buckets = packed.sparkSession.sparkContext.broadcast(member_bits(kept, "h")), bucket_count(packed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = Block(batch.slice(i, 1).to_pylist()[0])
                n = len(x.size)
                if not n:
                    continue
                hashed = x.prefix_hash(int(x.size.max()), np.arange(n))
                alive = np.stack([is_member(shared.value, x.hashes(np.full(n, k), hashed)) for k in range(len(x.names))])
                use = alive[x.lang, x.term]
                cell, at = np.unique(x.group[use].astype(np.int64) * n + x.term[use], return_inverse=True)
                if not len(cell):
                    continue
                times = np.bincount(at, x.times[use]).astype(np.int64)
                group, term = cell // n, cell % n
                names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [
                    None, pa.py_buffer(x.ends.astype(np.int64)), pa.py_buffer(x.data[x.data != 0])])
                yield dealt(buckets, x.langs, x.sources, group, names, term, x.hashes(x.lang_of_group[group], hashed[term]), times)

    # the filter lets some terms pass that are not kept
    rows = summed(packed.mapInArrow(count, DEALT), 1).select("lang", "source", F.col("item").cast("string").alias("term"), "n")
    return rows.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")


def share(n: str, total: str, terms: str):
    """p of a count; in decimals, so that no corpus is too large."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + 1 as decimal(20, 0))) div cast({total} + {terms} as decimal(20, 0))")


def gap(p: str, q: str) -> str:
    """floor((p - q)^2 / q); p and q are at most 10^9 + 1, so the square fits in a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def exact_sum(x: str):
    """Sum of longs as a decimal: of the upper and the lower bits apart, which no sum can overflow."""
    return F.expr(f"cast(sum(shiftright({x}, 30)) as decimal(38, 0)) * 1073741824 + cast(sum(({x}) & 1073741823) as decimal(38, 0))")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each group the other sources
    of its language (``pair``) and its ``top`` overused terms (``term``)."""
    packed = blocks(docs)
    kept = written(kept_terms(packed, least), "divergence-kept")
    counts = written(term_counts(packed, kept), "divergence-counts")
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = written(
        occurring.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
        .withColumn("zero", F.when(F.col("terms") > 0, share("0", "total", "terms"))), "divergence-groups")
    shares = written(counts.join(groups, ["lang", "source"])
                     .select("lang", "source", "term", "n", "zero", share("n", "total", "terms").alias("p")), "divergence-shares")
    value = _pairs(groups, shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = _terms(groups, shares).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = "row_number() over (partition by lang, source, part order by value desc, item)"
    return value.withColumn("rank", F.expr(rank)).unionByName(terms.withColumn("rank", F.expr(rank)).filter(F.col("rank") <= top))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value."""
    g, h = [groups.select("lang", F.col("source").alias(f"s_{x}"), F.col("zero").alias(f"z_{x}"), "terms") for x in "gh"]
    every = g.join(h.drop("terms"), "lang").filter("s_g != s_h")
    # terms that one source has, as if the other had none: by distinct shares
    spectrum = shares.groupBy("lang", "source", "zero", "p").agg(F.count(F.lit(1)).alias("times"))
    own = spectrum.select("lang", F.col("source").alias("s_own"), F.col("zero").alias("z_own"), "p", "times") \
        .join(groups.select("lang", F.col("source").alias("s_other"), F.col("zero").alias("z_other")), "lang").filter("s_own != s_other")
    more = own.selectExpr("lang", "s_own", "s_other", f"cast(times as decimal(20, 0)) * ({gap('p', 'z_other')} - {gap('z_own', 'z_other')}) as first",
                          f"cast(times as decimal(20, 0)) * ({gap('z_other', 'p')} - {gap('z_other', 'z_own')}) as second") \
        .groupBy("lang", "s_own", "s_other").agg(F.sum("first").alias("first"), F.sum("second").alias("second"))
    # terms that both have, each pair of sources once
    a, b = [shares.select("lang", "term", F.col("source").alias(f"s_{x}"), F.col("zero").alias(f"z_{x}"), F.col("p").alias(f"p_{x}")) for x in "ab"]
    both = a.join(b, ["lang", "term"]).filter("s_a < s_b")
    turn = {}
    for x, y in ("ab", "ba"):
        p, q, z, w = f"p_{x}", f"p_{y}", f"z_{x}", f"z_{y}"
        turn[x + y] = f"{gap(p, q)} - {gap(p, w)} - {gap(z, q)} + {gap(z, w)}"
    common = both.groupBy("lang", "s_a", "s_b").agg(*[exact_sum(f"({e})").alias(k) for k, e in turn.items()])
    common = common.selectExpr("lang", "stack(2, s_a, s_b, ab, s_b, s_a, ba) as (s_g, s_h, common)")
    first = more.select("lang", F.col("s_own").alias("s_g"), F.col("s_other").alias("s_h"), "first")
    second = more.select("lang", F.col("s_other").alias("s_g"), F.col("s_own").alias("s_h"), "second")
    keys = ["lang", "s_g", "s_h"]
    return every.join(first, keys, "left").join(second, keys, "left").join(common, keys, "left").selectExpr(
        "lang", "s_g as source", "s_h as item",
        f"cast(coalesce(cast(terms as decimal(20, 0)) * ({gap('z_g', 'z_h')}), 0) + coalesce(first, 0) + coalesce(second, 0) + coalesce(common, 0) as long) as value")


def _terms(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item (a term that the source uses more than its language), value."""
    total = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    whole = shares.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(total, "lang").select("lang", "term", share("n", "total", "terms").alias("q"))
    return shares.join(whole, ["lang", "term"]).filter("p > q").selectExpr("lang", "source", "term as item", f"{gap('p', 'q')} as value")
