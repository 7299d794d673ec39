"""Exact n-gram Jaccard self-join by universe partition and pigeonhole.

A text's set holds its distinct shingles of the rule's words.  Sets of sizes a
and b link when ``common >= t * union``, t being the rule's least similarity,
so they differ in at most ``d = (a + b) (1 - t) / (1 + t)`` shingles.  Sizes fall in bands such that partners are
in the same band or in the next one.  For a band, a hash deals all shingles to
``m = H + 1 + r`` segments, ``H`` being the largest difference of a partner
pair: at least ``r + 1`` segments of a pair are equal.  Each set is indexed by
the hash of its subset in every segment, in its own band's partition and in
the band's below (for smaller partners).

Allocation: an empty segment says nothing and is not indexed.  If a set has
more than ``r`` of them, the equal segments of a pair may all be empty; such
sets get the dearer keys instead: half as many segments (``H // 2 + 1``, so
that one differs in one shingle at most), each indexed by its subset and by
every subset with one shingle deleted.  Two sets with too many empty segments
share such a key; if one has few, the first kind suffices.

A linked pair shares at least ``m - r - d`` keys of the first kind, so sets
with fewer shared keys than any partner demands are dropped first.  What is
left is verified on the whole sets, in rounds that grow components (:mod:`.linking`).

Shingles, sets and keys are 64-bit hashes; equal sets are one node from the
start.  Rows: null texts and texts without words have size 0 and link with
nothing; a text of fewer words than a shingle has its whole word sequence as
its one shingle; repeated rows are rows of their own; a null ``doc_id`` never
is the least id of its group; other columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, row_id, written
from .exact_dedup import flag_members, member_bits
from .linking import Rule, connect, flat_members, linked
from .words import coded_words, doc_of, text_slices

SPARSE = 128            # marks keys of the second kind in the key's last byte
MAX_SIZE = 1 << 40
SLICE_BYTES = 2 << 20   # text whose sets are held at a time
KEY_ROWS = 1 << 17      # keys that a worker hands over at a time


RULE = Rule()           # of the op10 query


def bands(rule: Rule = RULE) -> np.ndarray:
    """Least size of every band: the next starts above least / t."""
    out = [1]
    while out[-1] < MAX_SIZE:
        out.append(out[-1] * rule.denominator // rule.numerator + 1)
    return np.array(out, np.int64)


def partition(band: int, least: np.ndarray, rule: Rule = RULE) -> tuple[int, int, int]:
    """H, r and m of a band's partition."""
    upper = int(least[band + 1]) - 1
    a, b = rule.difference()
    h = a * (upper + upper * rule.denominator // rule.numerator) // b
    r = 2 + (h + 1) // 12
    return h, r, h + 1 + r


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, rule: Rule = RULE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and bounds per text."""
    names, codes, bounds = coded_words(texts)
    words = pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False) if len(names) else np.zeros(0, np.uint64)
    w, doc = words[codes], doc_of(bounds)
    prime = np.uint64(0x9E3779B97F4A7C15)
    n, k = np.diff(bounds), rule.shingle
    whole = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for j in range(k):
        whole = whole * prime + w[j:len(w) - k + 1 + j]
    whole = mix(whole)
    out, sizes = [], np.zeros(len(n), np.int64)
    for d in range(len(n)):
        a, b = int(bounds[d]), int(bounds[d + 1])
        if b - a >= k:
            s = np.unique(whole[a:b - k + 1])
        elif b > a:
            x = np.array([b - a + 0x5851F42D4C957F2D], np.uint64)
            for j in range(a, b):
                x = x * prime + w[j]
            s = mix(x)
        else:
            continue
        out.append(s)
        sizes[d] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def fingerprints(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit hash per set, whatever the order of its members."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    np.add.at(out, doc_of(bounds), mix(sets ^ np.uint64(0xD1B54A32D192ED03)))
    return mix(out + np.diff(bounds).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


def _key(value: np.ndarray, part: np.ndarray, segment: np.ndarray, last: int | np.ndarray) -> np.ndarray:
    x = mix(value ^ mix(part.astype(np.uint64) * np.uint64(1 << 32) + segment.astype(np.uint64) + np.uint64(77)))
    return (x & ~np.uint64(0xFF)) | np.asarray(last).astype(np.uint64)


def signatures(sets: np.ndarray, bounds: np.ndarray, least: np.ndarray, rule: Rule = RULE) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sets and the number of keys per set."""
    n = np.diff(bounds)
    band = np.searchsorted(least, n, side="right") - 1
    plans = np.array([partition(k, least, rule) for k in range(max(1, int(band.max(initial=0)) + 1))])
    keys, owners = [], []
    token = mix(sets + np.uint64(0x632BE59BD9B4E019))
    doc = doc_of(bounds)
    for part in (band, band - 1):
        use = (n > 0) & (part >= 0)
        use[use] &= plans[part[use], 0] > 0     # where no difference is allowed, partners are equal sets
        if not use.any():
            continue
        chosen = np.where(use, part, 0)
        for sparse in (False, True):
            m = np.where(use, plans[chosen, 0] // 2 + 1 if sparse else plans[chosen, 2], 0)
            first = np.concatenate([[0], np.cumsum(m)])
            mine = use[doc]
            d, t, h = doc[mine], token[mine], sets[mine]
            segment = (mix(t ^ (chosen[d].astype(np.uint64) * np.uint64(2) + np.uint64(sparse)) * np.uint64(0xA0761D6478BD642F))
                       >> np.uint64(11)) % m[d].astype(np.uint64)
            cell = first[d] + segment.astype(np.int64)
            total = np.zeros(int(first[-1]), np.uint64)
            np.add.at(total, cell, h)
            filled = np.bincount(cell, minlength=len(total)) > 0
            owner = np.repeat(np.arange(len(n)), m)
            seg = np.arange(len(total)) - first[owner]
            last = chosen[owner] % SPARSE
            if not sparse:
                keys.append(_key(total, chosen[owner], seg, last)[filled])
                owners.append(owner[filled])
                empty = m - np.bincount(owner[filled], minlength=len(n))
                use = use & (empty > plans[chosen, 1])
                if not use.any():
                    break
            else:
                keys += [_key(total, chosen[owner] + 4096, seg, last + SPARSE),
                         _key(total[cell] - h, chosen[d] + 4096, seg[cell], last[cell] + SPARSE)]
                owners += [owner, d]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(n), np.int64)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return key[order], np.bincount(owner, minlength=len(n))


def described(docs: DataFrame, row: str | None = None, rule: Rule = RULE) -> DataFrame:
    """Per row: row, doc_id, n, node (hash of the set), text_key, keys (packed), written once."""
    least = bands(rule)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, last in text_slices(whole.column(2), SLICE_BYTES):
                b = whole.slice(first, last - first)
                sets, bounds = shingle_sets(b.column(2), rule)
                n = np.diff(bounds)
                key, per = signatures(sets, bounds, least, rule)
                cut = np.concatenate([[0], np.cumsum(per)])
                raw = key.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n), pa.array(fingerprints(sets, bounds), mask=n == 0), b.column(3),
                     pa.array([raw[8 * cut[i]:8 * cut[i + 1]] for i in range(len(n))], pa.binary())],
                    names=["row", "doc_id", "n", "node", "text_key", "keys"])

    text = F.col("text").cast("string")
    return written(docs.select(row_id(row), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                               F.xxhash64(text).alias("text_key"))
                   .mapInArrow(alone(describe), "row long, doc_id long, n long, node long, text_key long, keys binary"), "sets")


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) of nodes and their packed keys, ``KEY_ROWS`` at a time."""
    for b in batches:
        flat, bounds = flat_members(pa.chunked_array([b.column(1)]))
        node = np.asarray(b.column(0))
        for first in range(0, len(flat), KEY_ROWS):
            part = flat[first:first + KEY_ROWS].view("<i8")
            owner = np.searchsorted(bounds, np.arange(first, first + len(part)), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(node[owner])], names=["key", "node"])


def shared_keys(rows: DataFrame) -> DataFrame:
    """key, node: the keys that two different sets or more have."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by (key, node); the last distinct pair waits for its successor.
        held_key, held_node, held_shared = None, None, False
        for b in batches:
            key, node = np.asarray(b.column(0)), np.asarray(b.column(1))
            if held_key is not None:
                key, node = np.concatenate([[held_key], key]), np.concatenate([[held_node], node])
            if not len(key):
                continue
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node = key[new], node[new]
            before = np.concatenate([[held_shared], key[1:] == key[:-1]])
            after = np.concatenate([key[1:] == key[:-1], [False]])
            keep = (before | after)[:-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep]), pa.array(node[:-1][keep])], names=["key", "node"])
            held_key, held_node, held_shared = key[-1], node[-1], bool(before[-1])
        if held_shared:
            yield pa.RecordBatch.from_arrays([pa.array([held_key], pa.int64()), pa.array([held_node], pa.int64())],
                                             names=["key", "node"])

    pairs = rows.filter("n > 0").select("node", "keys").mapInArrow(alone(key_rows), "key long, node long")
    return written(pairs.repartition("key").sortWithinPartitions("key", "node").mapInArrow(alone(runs), "key long, node long"), "keys")


def _band() -> Column:
    return F.col("key").bitwiseAND(SPARSE - 1).alias("band")


def _kind() -> Column:
    return (F.col("key").bitwiseAND(SPARSE) != 0).alias("sparse")


def _table(values: list[int]) -> Column:
    """Look-up of a number per band."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("band") + 1).cast("int"))


def _least_shared(rule: Rule) -> Column:
    """Keys of the first kind that a pair shares at least, but for its difference: m - r."""
    least = bands(rule)
    return _table([m - r for _, r, m in (partition(k, least, rule) for k in range(min(SPARSE, len(least) - 1)))])


def partnered(keys: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """The keys (key, node, n) of sets that share as many keys as some partner
    size demands, where such sets are at least two."""
    upper = _table([int(x) - 1 for x in bands(rule)[1:SPARSE + 1]])
    # the largest partner: in the own band's partition any, in the lower one its upper end
    partner = F.when(F.col("n") <= upper, F.floor(F.col("n") * rule.denominator / rule.numerator)).otherwise(upper)
    demand = _least_shared(rule) - rule.most(F.col("n") + partner)
    counts = keys.select("node", _band(), _kind()).groupBy("node", "band").agg(
        F.count_if(~F.col("sparse")).alias("shared"), F.count_if("sparse").alias("dear")).join(sizes, "node")
    able = counts.filter((F.col("dear") > 0) | (F.col("shared") >= demand)).select("node", "band", "n")
    kept = keys.withColumn("band", _band()).join(able, ["node", "band"]).select("key", "node", "n")
    several = kept.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key")
    return kept.join(several, "key", "left_semi")


def _sets_of(docs: DataFrame, rows: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """node, members (packed, sorted): sets of the given nodes, from one text of each."""
    wanted = written(rows.filter("n > 0").join(nodes, "node", "left_semi").groupBy("node")
                     .agg(F.min("text_key").alias("text_key")), "wanted")
    text = F.col("text").cast("string")
    texts = flag_members(docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")), "text_key",
                         member_bits(wanted, "text_key"))
    # equal texts are one: the first that meets the node
    texts = texts.dropDuplicates(["text_key"]).join(wanted, "text_key")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, last in text_slices(whole.column(0), SLICE_BYTES):
                b = whole.slice(first, last - first)
                sets, bounds = shingle_sets(b.column(0), rule)
                own = fingerprints(sets, bounds) == np.asarray(b.column(1))
                raw = sets.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(1), pa.array([raw[8 * bounds[i]:8 * bounds[i + 1]] for i in range(len(own))], pa.binary())],
                    names=["node", "members"]).filter(pa.array(own))

    return texts.select("text", "node").mapInArrow(alone(members), "node long, members binary")


def star_pairs(marked: DataFrame, turn: int, rule: Rule) -> DataFrame:
    """Pairs (u, v) of sets: under each key the component first in this turn's
    order with each of the others, one set of each, where the keys that the
    two sets share this way are as many as their sizes demand."""
    order = F.struct(F.xxhash64(F.lit(turn), "c").alias("h"), F.xxhash64(F.lit(turn), "node").alias("g"), "c", "node", "n")
    one = marked.groupBy("key", "c").agg(F.min(order).alias("s"))
    head = one.groupBy("key").agg(F.min("s").alias("head"))
    pairs = one.join(head, "key").filter("c != head.c").select(
        F.col("head.node").alias("u"), F.col("s.node").alias("v"), F.col("head.n").alias("nu"), F.col("s.n").alias("nv"), _band(), _kind())
    most = rule.most(F.col("nu") + F.col("nv"))
    return pairs.groupBy("u", "v", "nu", "nv", "band", "sparse").agg(F.count(F.lit(1)).alias("shared")).filter(
        (F.least("nu", "nv") * rule.denominator >= F.greatest("nu", "nv") * rule.numerator)
        & (F.col("sparse") | (F.col("shared") >= _least_shared(rule) - most))).select("u", "v").distinct()


def open_pairs(marked: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (cu, cv) of components that share a key and as many keys as their
    largest sets demand."""
    groups = marked.groupBy("key", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    side = [groups.select("key", *[F.col(x).alias(f"{x}{k}") for x in ("c", "lo", "hi")]) for k in "uv"]
    both = side[0].join(side[1], "key").filter("cu < cv").groupBy("cu", "cv", _band(), _kind()).agg(
        F.count(F.lit(1)).alias("shared"), *[F.min(f"lo{k}").alias(f"lo{k}") for k in "uv"], *[F.max(f"hi{k}").alias(f"hi{k}") for k in "uv"])
    most = rule.most(F.col("hiu") + F.col("hiv"))
    return both.filter((F.col("hiu") * rule.denominator >= F.col("lov") * rule.numerator)
                       & (F.col("hiv") * rule.denominator >= F.col("lou") * rule.numerator)
                       & (F.col("sparse") | (F.col("shared") >= _least_shared(rule) - most))).select("cu", "cv").distinct()


def links(docs: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """Components (node, root) of all linked nodes that are no roots."""
    sizes = written(rows.filter("n > 0").select("node", "n").distinct(), "sizes")
    keys = written(partnered(shared_keys(rows), sizes, rule), "partnered")
    sets = written(_sets_of(docs, rows, keys.select("node"), rule), "members")
    return connect(keys, sets, rule, lambda marked, turn: linked(star_pairs(marked, turn, rule), sets, rule),
                   lambda marked: open_pairs(marked, rule))


def near_groups(docs: DataFrame, row: str | None = None, rule: Rule = RULE) -> DataFrame:
    """Per row: row, doc_id, n_shingles, component_id (least doc_id of its
    group), node, group (null for rows without words)."""
    rows = described(docs, row, rule)
    roots = links(docs, rows, rule)
    grouped = rows.select("row", "doc_id", "n", "node").join(roots, "node", "left") \
        .select("row", "doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("root", "node").alias("group"))
    least = grouped.filter("group is not null").groupBy("group").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head"))
    return grouped.join(least, "group", "left").select(
        "row", "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "node", "group",
        F.coalesce(F.col("head.row"), F.col("row")).alias("head_row"))
