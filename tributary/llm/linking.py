"""From shared keys to components of sets that link, by exact comparison.

Sets that link share a key.  Which of them are compared goes in rounds that
grow components:

* Star rounds pair each key's components with one of them only (another one
  each round), by one set of each.  A group of k near copies costs about k
  pairs a round.  Rounds end when they merge little.
* The last step takes every pair of *different* components under a key (where
  the caller finds that they may link), and compares the sets of both that
  still share a key with another component, in blocks of bounded bytes: two
  blocks meet in one task, which emits links, not pairs.  Under a key where
  more than ``HEAVY`` components are left (near copies of one text that are
  not near enough to each other), pairs of components are not listed: its
  sets, with those that they share such keys with, are one family, compared
  block by block; other keys within the family need no pairs then.

So no link between components is lost, whatever the rounds found.  Without
shared keys there is no round at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, written
from .components import components

BLOCK_BYTES = 1 << 20   # members of the sets of a block (a larger set is a block of its own, or meets others by chance of its hash)
BLOCK_SETS = 1024
HEAVY = 16              # components under a key beyond which its sets are compared as one family


class Rule(NamedTuple):
    """Which sets link: words of a shingle, least similarity as a fraction."""

    shingle: int = 4
    numerator: int = 85
    denominator: int = 100

    def difference(self) -> tuple[int, int]:
        """(1 - t) / (1 + t) in lowest terms: shingles that partners differ in, to the sum of their sizes."""
        a, b = self.denominator - self.numerator, self.denominator + self.numerator
        return a // math.gcd(a, b), b // math.gcd(a, b)

    def most(self, total: Column) -> Column:
        """Shingles that partners of this sum of sizes differ in at most."""
        a, b = self.difference()
        return F.floor(a * total / b)


def flat_members(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Members of all sets (packed, 8 bytes each), one after the other, and bounds."""
    whole = column.combine_chunks().cast(pa.large_binary()) if column.num_chunks != 1 else column.chunk(0).cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + len(whole) + 1]
    if not len(whole) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(whole) + 1, np.int64)
    return np.frombuffer(whole.buffers()[2], "<u8", (offsets[-1] - offsets[0]) // 8, int(offsets[0])), (offsets - offsets[0]) // 8


def common_members(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def linked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) whose sets link, by exact intersection."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                n = common_members(x, y)
                keep[i] = rule.denominator * n >= rule.numerator * (len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep))

    su, sv = [sets.select(F.col("node").alias(x), F.col("members").alias(f"set_{x}")) for x in "uv"]
    return pairs.join(su, "u").join(sv, "v").select("u", "v", "set_u", "set_v").mapInArrow(alone(verify), "u long, v long")


def with_components(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, n, c; only keys under which two components or more meet."""
    marked = keys.join(roots.select("node", F.col("root").alias("c")), "node", "left") \
        .select("key", "node", "n", F.coalesce("c", "node").alias("c"))
    several = marked.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a < b").select("key")
    return marked.join(several, "key", "left_semi")


def links_between(pairs: DataFrame, own: DataFrame, rule: Rule) -> DataFrame:
    """Links (u, v) between different components (``c``) of the groups (``g``)
    in each pair (ga, gb), found by comparing all sets of one with all of the
    other, in blocks: of a block's links only those that join two components
    which the ones before have not joined."""
    count = F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum(F.length("members")) / BLOCK_BYTES)
    size = own.groupBy("g").agg(F.ceil(count).cast("int").alias("blocks"))
    sa, sb = [size.select(F.col("g").alias(f"g{k}"), F.col("blocks").alias(f"n{k}")) for k in "ab"]
    todo = pairs.join(sa, "ga").join(sb, "gb")
    block = F.xxhash64("node")

    def side(k: str, names: list[str]) -> DataFrame:
        other = "b" if k == "a" else "a"
        rows = todo.join(own.withColumnRenamed("g", f"g{k}"), f"g{k}").withColumn(k, F.pmod(block, F.col(f"n{k}")).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)))
        return rows.filter("ga != gb or a <= b").select(*[F.col(x).alias(y) for x, y in zip(["ga", "gb", "a", "b"], names)], "node", "c", "members")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        flat, bounds = flat_members(left.column("members"))
        names, groups, sizes = np.asarray(left.column("node")), np.asarray(left.column("c")), np.diff(bounds)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        others, cuts = flat_members(right.column("members"))
        out, parent = [], {}

        def root(x: int) -> int:
            while (above := parent.get(x, x)) != x:
                parent[x] = parent.get(above, above)
                x = above
            return x

        for k, (node, c) in enumerate(zip(right.column("node").to_pylist(), right.column("c").to_pylist())):
            y = others[cuts[k]:cuts[k + 1]]
            a = np.searchsorted(flat, y)
            n = np.searchsorted(flat, y, side="right") - a
            common = np.bincount(owner[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sizes))
            hit = np.flatnonzero((rule.denominator * common >= rule.numerator * (sizes + len(y) - common)) & (groups != c))
            for i in np.unique(groups[hit], return_index=True)[1]:
                one, two = root(int(groups[hit[i]])), root(c)
                if one != two:
                    parent[one] = two
                    out.append((node, int(names[hit[i]])))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([x for _, x in out], pa.int64())})

    return side("a", ["ga", "gb", "a", "b"]).groupBy("ga", "gb", "a", "b").cogroup(
        side("b", ["ha", "hb", "i", "j"]).groupBy("ha", "hb", "i", "j")).applyInArrow(compare, "u long, v long")


def families(heavy: DataFrame) -> DataFrame:
    """node, g: sets that share a heavy key, directly or through others, are one family."""
    return heavy.select("node").distinct().join(components(family_links(heavy)), "node", "left").select("node", F.coalesce("root", "node").alias("g"))


def family_links(heavy: DataFrame) -> DataFrame:
    """Links (u, v) that make the nodes of a key, and keys with a common node,
    one component: of a node and its least key head, and of that head and the
    others of the node; not one of every node and head.  Each row of ``heavy``
    is joined once, to its key's head."""
    head = heavy.groupBy("key").agg(F.min("node").alias("u"))
    heads = written(heavy.join(head, "key").groupBy("node").agg(F.sort_array(F.collect_set("u")).alias("heads")), "heads")
    least = F.element_at("heads", 1).alias("u")
    return heads.select(least, F.col("node").alias("v")).unionByName(
        heads.select("heads").distinct().select(least, F.explode("heads").alias("v"))).filter("u != v").distinct()


def connect(keys: DataFrame, sets: DataFrame, rule: Rule, star_links: Callable[[DataFrame, int], DataFrame],
            open_pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components (node, root) of all linked nodes that are no roots.

    ``keys`` are (key, node, n), ``sets`` (node, members).  ``star_links``
    gives the links of a star round, ``open_pairs`` the component pairs
    (cu, cv) that may link.
    """
    found: list[DataFrame] = []
    roots = keys.sparkSession.createDataFrame([], "node long, root long")
    marked, turn, before = keys.withColumn("c", F.col("node")), 0, None
    while True:
        here = marked.agg(F.count_distinct("c")).first()[0]
        if not here:
            return roots
        # another round while the last one merged a tenth of the open components
        if before is not None and here > 0.9 * before:
            break
        before, turn = here, turn + 1
        found.append(written(star_links(marked, turn), "found"))
        roots = components(reduce(DataFrame.unionByName, found))
        marked = written(with_components(keys, roots), "marked")
    own = written(sets.join(marked.select("node", "c").distinct(), "node").select("node", "members", "c"), "own")
    busy = marked.groupBy("key").agg(F.count_distinct("c").alias("k")).filter(F.col("k") > HEAVY).select("key")
    heavy = written(marked.join(busy, "key", "left_semi").select("key", "node"), "heavy")
    rest = marked.join(heavy.select("key").distinct(), "key", "left_anti")
    more = None
    if not heavy.isEmpty():
        family = written(families(heavy), "families")
        self_pairs = family.select(F.col("g").alias("ga"), F.col("g").alias("gb")).distinct()
        more = links_between(self_pairs, own.join(family, "node"), rule)
        # a family is compared as a whole, so keys within one family need no pairs of their own
        inner = rest.join(family, "node", "left").groupBy("key").agg(
            F.min("g").alias("a"), F.max("g").alias("b"), F.count_if(F.col("g").isNull()).alias("free")).filter("free = 0 and a = b").select("key")
        rest = rest.join(inner, "key", "left_anti")
    light = open_pairs(rest).select(F.col("cu").alias("ga"), F.col("cv").alias("gb"))
    light = links_between(light, own.withColumn("g", F.col("c")), rule)
    more = light if more is None else more.unionByName(light)
    more = written(more, "found")
    return roots if more.isEmpty() else components(reduce(DataFrame.unionByName, [*found, more]))
