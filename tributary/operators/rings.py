"""Rings of a union's outline by distributed list ranking.

:func:`.spatial.union_walls` gives the outline of each group as directed edges
with the union on their left.  An edge is followed by the outgoing edge that
comes first clockwise from its own reverse, so a walk stays along one corner
of the union where several meet in a point.  The walks are cycles; no task
ever holds one:

* pointer doubling gives every edge the least edge of its cycle, in as many
  rounds as the longest cycle's length has bits;
* a walk that comes to a vertex more than once is split there (the edge that
  arrives at one visit goes on with the departure of the visit before), so
  every ring is simple: a hole that touches its outline is a ring of its own;
* pointer doubling from every edge to its cycle's first one gives the
  distance, and so the vertex numbers.

Rings with positive area are outlines of parts, the others are holes; a hole
belongs to the smallest part that contains the middle of its first edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spatial import _ray_cast, box_candidates, kept, union_walls


def _successors(edges: DataFrame, group: str) -> DataFrame:
    """``e, next`` for directed edges (group, e, x1, y1, x2, y2)."""
    a = edges.select(group, "e", F.col("x2").alias("_x"), F.col("y2").alias("_y"), (F.col("x1") - F.col("x2")).alias("_bx"), (F.col("y1") - F.col("y2")).alias("_by"))
    b = edges.select(group, F.col("e").alias("next"), F.col("x1").alias("_x"), F.col("y1").alias("_y"),
                     (F.col("x2") - F.col("x1")).alias("_dx"), (F.col("y2") - F.col("y1")).alias("_dy"))
    # clockwise angle from the reverse edge to a departure: in (0, 2 pi]; the edges at a vertex are few
    turn = F.atan2(F.col("_by"), F.col("_bx")) - F.atan2(F.col("_dy"), F.col("_dx"))
    turn = F.when(turn <= 1e-12, turn + 2 * 3.141592653589793).otherwise(turn)
    return a.join(b, [group, "_x", "_y"]).groupBy("e").agg(F.min_by("next", F.struct(turn, "next")).alias("next"))


def _cycles(links: DataFrame) -> DataFrame:
    """``e, ring``: the least edge of the cycle of each edge of (e, next)."""
    now = kept(links.select("e", F.col("next").alias("ptr"), F.least("e", "next").alias("ring")))
    while True:
        twice = _label_step(_label_step(now.withColumn("first", F.col("ring"))))
        now = kept(twice.select("e", "ptr", "ring", (F.col("ring") < F.col("first")).alias("moved")))
        # the least edge's label reaches twice as many edges a step until it has reached all
        if now.where("moved").isEmpty():
            return now.select("e", "ring")
        now = now.drop("moved")


def _label_step(now: DataFrame) -> DataFrame:
    far = now.select(F.col("e").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("ring").alias("_ring"))
    return now.join(far, "ptr").select("e", F.col("_ptr").alias("ptr"), F.least("ring", "_ring").alias("ring"), "first")


def _distance_step(now: DataFrame) -> DataFrame:
    far = now.select(F.col("e").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("steps").alias("_steps"))
    return now.join(far, "ptr").select("e", "ring", F.col("_ptr").alias("ptr"), (F.col("steps") + F.col("_steps")).alias("steps"))


def _positions(links: DataFrame, cycles: DataFrame) -> DataFrame:
    """``e, ring, v``: place of each edge in its cycle, 0 at the least edge."""
    now = kept(links.join(cycles, "e").select(
        "e", "ring", F.when(F.col("e") == F.col("ring"), F.col("e")).otherwise(F.col("next")).alias("ptr"),
        F.when(F.col("e") == F.col("ring"), 0).otherwise(1).cast("long").alias("steps")))
    while not now.where("ptr != ring").isEmpty():
        now = kept(_distance_step(_distance_step(now)))
    size = now.groupBy("ring").agg(F.count(F.lit(1)).alias("_n"))
    return now.join(size, "ring").select("e", "ring", F.pmod(F.col("_n") - F.col("steps"), F.col("_n")).alias("v"))


def _split(edges: DataFrame, links: DataFrame, cycles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and cycles after walks that repeat a vertex are split there."""
    at = cycles.join(edges.select("e", F.col("x1").alias("_x"), F.col("y1").alias("_y")), "e")
    twice = kept(at.groupBy("ring", "_x", "_y").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k"))
    if twice.isEmpty():
        return links, cycles
    own = cycles.join(twice.select("ring").distinct(), "ring", "left_semi")
    place = _positions(links.join(own.select("e"), "e", "left_semi"), own)
    visits = place.join(edges.select("e", F.col("x1").alias("_x"), F.col("y1").alias("_y")), "e").join(twice, ["ring", "_x", "_y"])
    # the departure of the visit before (of the last one for the first); the visits of a vertex are few
    order = W.partitionBy("ring", "_x", "_y").orderBy("v")
    last = F.max_by("e", "v").over(W.partitionBy("ring", "_x", "_y"))
    moved = visits.select(F.col("e").alias("next"), F.coalesce(F.lag("e").over(order), last).alias("_new"))
    links = kept(links.join(moved, "next", "left").select("e", F.coalesce("_new", "next").alias("next")))
    again = _cycles(links.join(own.select("e"), "e", "left_semi"))
    return links, kept(cycles.join(own.select("e"), "e", "left_anti").unionByName(again))


def union_rings(rings: DataFrame, group: str, poly_id: str, cell: float) -> DataFrame:
    """Outline of the union of each group's polygons (A20) as rings ``(group,
    part, ring, hole, v, x, y)``, vertices in order with the union on the left.

    ``ring`` counts from 0 in each group by the least vertex; ``part`` is the
    ring of the part's outline.  The closing edge is implied, so the rings
    feed :func:`.spatial.ring_edges` with ``ring`` as they are.
    """
    walls = union_walls(rings, group, poly_id, cell)
    a, b = (F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in "12")
    first, last = F.when(F.col("left"), a).otherwise(b), F.when(F.col("left"), b).otherwise(a)
    edges = kept(walls.select(group, first.alias("_a"), last.alias("_b")).select(
        group, F.monotonically_increasing_id().alias("e"), F.col("_a.x").alias("x1"), F.col("_a.y").alias("y1"),
        F.col("_b.x").alias("x2"), F.col("_b.y").alias("y2")))
    links = kept(_successors(edges, group))
    links, cycles = _split(edges, links, _cycles(links))
    # the walk's first edge departs from the ring's least vertex
    heads = cycles.join(edges, "e").groupBy("ring").agg(F.min_by("e", F.struct("x1", "y1")).alias("_head"))
    cycles = kept(cycles.join(heads, "ring").select("e", F.col("_head").alias("ring")))
    placed = kept(_positions(links, cycles).join(edges, "e"))
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    whole = placed.groupBy(group, F.col("ring").alias("_ring")).agg(
        area.alias("area"), F.min_by(F.struct("x1", "y1", "x2", "y2"), "v").alias("head"))
    # one row a ring; sorted, never held
    whole = kept(whole.withColumn("ring", (F.row_number().over(W.partitionBy(group).orderBy("head")) - 1).cast("int")))
    outer = whole.where("area > 0").select(group, F.col("ring").alias("part"), "area", "_ring")
    walls = placed.withColumnRenamed("ring", "_ring").join(outer, [group, "_ring"]).select(group, "part", "x1", "y1", "x2", "y2")
    mids = whole.where("area < 0").select(group, F.struct(group, "ring").alias("_pt"), ((F.col("head.x1") + F.col("head.x2")) / 2).alias("px"),
                                          ((F.col("head.y1") + F.col("head.y2")) / 2).alias("py"))
    keys = [group, "part"]
    inside = _ray_cast(box_candidates(mids, "_pt", walls, keys, cell, by=[group]), keys, "_pt", walls, cell, False)
    of = inside.join(outer.select(group, "part", "area"), keys).groupBy(group, F.col("_pt.ring").alias("ring")).agg(
        F.min_by("part", F.struct("area", "part")).alias("part"))
    named = whole.join(of, [group, "ring"], "left").select(
        group, "_ring", "ring", F.coalesce("part", "ring").alias("part"), (F.col("area") < 0).alias("hole"))
    return placed.withColumnRenamed("ring", "_ring").join(named, [group, "_ring"]).select(
        group, "part", "ring", "hole", F.col("v").cast("int").alias("v"), F.col("x1").alias("x"), F.col("y1").alias("y"))


def part_measures(rings: DataFrame, group: str) -> DataFrame:
    """``(group, part, x0, y0, area, length, n_holes)`` of each part of
    :func:`union_rings`: least vertex, area without holes, outline length."""
    n = rings.groupBy(group, "ring").agg(F.count(F.lit(1)).alias("_n"))
    a = rings.join(n, [group, "ring"]).withColumn("_next", (F.col("v") + 1) % F.col("_n"))
    b = rings.select(group, "ring", F.col("v").alias("_next"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    e = a.join(b, [group, "ring", "_next"])
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    least = F.min(F.struct("x", "y"))
    return e.groupBy(group, "part").agg(least.alias("_p"), (F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2).alias("area"),
                                        F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"),
                                        F.count_distinct(F.when(F.col("hole"), F.col("ring"))).alias("n_holes")) \
        .select(group, "part", F.col("_p.x").alias("x0"), F.col("_p.y").alias("y0"), "area", "length", "n_holes")
