"""Near-duplicate groups by MinHash, banding and exact confirmation.

A text's set holds its distinct shingles of the rule's words.  ``HASHES``
universal hash functions (multiply and add modulo 2^64) each keep their least
value over the set; two sets agree in a minimum with probability equal to
their similarity.  ``BANDS`` bands of ``ROWS`` minima are hashed to keys: sets
of similarity 0.8 share no key with probability (1 - 0.8^5)^40, about 10^-7,
and the chance falls steeply above.  Pairs of sets that share a key are
candidates.  Their signatures (8 bits of each minimum) are compared first:
pairs whose share of equal minima lies more than six standard deviations below
the least similarity are dropped.  The others are confirmed on their full
sets.  Which pairs under a key are compared, :mod:`.linking` decides, so a
group of k copies is never expanded to its k^2 pairs, and no candidate link
between components is lost.  Components come from alternating large-star and
small-star steps (:mod:`.components`).

Equal sets (by 128 bits) are one node from the start; shingles are 64-bit
hashes.

Rows: null texts and texts without words have size 0 and link with nothing; a
text of fewer words than a shingle has its whole word sequence as its one
shingle; very long texts are read whole; repeated rows are rows of their own;
a null ``doc_id`` never is the least id of its group unless all are null;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_id, written
from .exact_dedup import flag_members, member_bits
from .linking import Rule, connect, linked
from .ngram_join import fingerprints, mix, shingle_sets
from .words import text_slices

RULE = Rule(shingle=2, numerator=80)
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
STEP = 1 << 14          # shingles hashed at a time: they stay in the processor's cache
SLICE_BYTES = 4 << 20   # text whose sets are held at a time
SIGMAS = 6


def hash_functions(n: int = HASHES, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of the universal hash functions."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 64, (2, n), np.uint64)
    return a | np.uint64(1), b


def minima(sets: np.ndarray, bounds: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of every function over every set (largest value for an
    empty one), upper 32 bits: one row per set."""
    out = np.full((len(functions[0]), len(bounds) - 1), np.iinfo(np.uint64).max, np.uint64)
    x = mix(sets + np.uint64(0x3C6EF372FE94F82B))
    for first in range(0, len(x), STEP):
        last = min(len(x), first + STEP)
        doc = np.searchsorted(bounds, first, side="right") - 1
        end = np.searchsorted(bounds, last, side="left")
        docs = np.arange(doc, end)[np.diff(bounds[doc:end + 1]) > 0]
        cuts = np.maximum(bounds[docs], first) - first
        own = x[first:last]
        for k, (a, b) in enumerate(zip(*functions)):
            low = np.minimum.reduceat(own * a + b, cuts)
            out[k, docs] = np.minimum(out[k, docs], low)
    return (out >> np.uint64(32)).astype(np.uint32).T


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and band."""
    keys = np.zeros((len(low), BANDS), np.uint64)
    parts = low.reshape(len(low), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r] + np.uint64(r + 1))
    return mix(keys ^ (np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))).view(np.int64)


def second_print(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Another 64 bits of each set, independent of :func:`fingerprints`."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets * np.uint64(0xA0761D6478BD642F) + np.uint64(0xE7037ED1A0B428DB)), dtype=np.uint64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def described(held: DataFrame, rule: Rule) -> DataFrame:
    """Per row: row, doc_id, n, h1 and h2 (of the set), bands and signature (packed)."""
    functions = hash_functions()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in text_slices(b.column(2), SLICE_BYTES):
                sets, bounds = shingle_sets(b.column(2).slice(i, j - i), rule)
                low = minima(sets, bounds, functions)
                some = np.diff(bounds) > 0
                keys, sign = band_keys(low), (low & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.diff(bounds)),
                     pa.array(fingerprints(sets, bounds)), pa.array(second_print(sets, bounds)),
                     pa.array([k.tobytes() for k in keys], pa.binary(), mask=~some), pa.array([k.tobytes() for k in sign], pa.binary(), mask=~some)],
                    names=["row", "doc_id", "n", "h1", "h2", "bands", "sign"])

    return written(held.mapInArrow(describe, "row long, doc_id long, n long, h1 long, h2 long, bands binary, sign binary"), "minhash-rows")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """key, node, n: the band keys that two nodes or more have."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(2).to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), *[pa.array(np.repeat(np.asarray(b.column(k)), BANDS)) for k in range(2)]], names=["key", "node", "n"])

    pairs = nodes.select("node", "n", "bands").mapInArrow(explode, "key long, node long, n long")
    several = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key")
    return written(pairs.join(several, "key", "left_semi"), "minhash-keys")


def similar(pairs: DataFrame, signatures: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose signatures do not rule out that they link."""
    t = rule.numerator / rule.denominator
    least = t - SIGMAS * (t * (1 - t) / HASHES) ** 0.5

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array((x == y).mean(axis=1) >= least))

    su, sv = [signatures.select(F.col("node").alias(x), F.col("sign").alias(f"sign_{x}")) for x in "uv"]
    return pairs.join(su, "u").join(sv, "v").select("u", "v", "sign_u", "sign_v").mapInArrow(estimate, "u long, v long")


def fits(a: str, b: str, rule: Rule):
    """Sizes of sets that may link: the smaller is at least t of the larger."""
    return (F.col(a) * rule.denominator >= F.col(b) * rule.numerator) & (F.col(b) * rule.denominator >= F.col(a) * rule.numerator)


def star_pairs(marked: DataFrame, turn: int, rule: Rule) -> DataFrame:
    """Under each key the component first in this turn's order with each of
    the others, one set of each, as distinct pairs (u, v)."""
    order = F.struct(F.xxhash64(F.lit(turn), "c").alias("h"), F.xxhash64(F.lit(turn), "node").alias("g"), "c", "node", "n")
    one = marked.groupBy("key", "c").agg(F.min(order).alias("s"))
    head = marked.groupBy("key").agg(F.min(order).alias("head"))
    return one.join(head, "key").filter("c != head.c").select(
        F.col("head.node").alias("u"), F.col("s.node").alias("v"), F.col("head.n").alias("a"), F.col("s.n").alias("b")) \
        .filter(fits("a", "b", rule)).select("u", "v").distinct()


def open_pairs(marked: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (cu, cv) of components that share a key and whose sizes may fit."""
    groups = marked.groupBy("key", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    side = [groups.select("key", *[F.col(x).alias(f"{x}{k}") for x in ("c", "lo", "hi")]) for k in "uv"]
    return side[0].join(side[1], "key").filter("cu < cv").filter(
        (F.col("hiu") * rule.denominator >= F.col("lov") * rule.numerator)
        & (F.col("hiv") * rule.denominator >= F.col("lou") * rule.numerator)).select("cu", "cv").distinct()


def near_groups(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id of its group),
    kept (it has that id)."""
    held = written(docs.select(row_id(None), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                   "minhash-texts", compression="zstd")
    rows = described(held, rule)
    least = rows.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("row").alias("node"))
    nodes = written(least.select("node").join(rows.withColumnRenamed("row", "node"), "node").select("node", "n", "bands", "sign"), "minhash-nodes")
    keys = shared_keys(nodes)
    wanted = keys.select("node").distinct()
    texts = flag_members(held.select(F.col("row").alias("node"), "text"), "node", member_bits(wanted, "node")).join(wanted, "node", "left_semi")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in text_slices(b.column(1), SLICE_BYTES):
                sets, bounds = shingle_sets(b.column(1).slice(i, j - i), rule)
                raw = sets.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([raw[8 * x:8 * y] for x, y in zip(bounds, bounds[1:])], pa.binary())], names=["node", "members"])

    sets = written(texts.select("node", "text").mapInArrow(members, "node long, members binary"), "minhash-sets")
    signatures = nodes.select("node", "sign")
    roots = connect(keys, sets, rule, lambda marked, turn: linked(similar(star_pairs(marked, turn, rule), signatures, rule), sets, rule),
                    lambda marked: open_pairs(marked, rule))
    placed = rows.select("doc_id", "n", "h1", "h2").join(least, ["h1", "h2", "n"], "left").join(roots, "node", "left") \
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("group"))
    first = placed.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("first"))
    component = F.coalesce("first", "doc_id")
    return placed.join(first, "group", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
