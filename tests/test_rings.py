"""Rings of unions, clipping and outline flags against brute force."""

import collections
import random

import pytest

from tributary.operators import rings as rg
from tributary.operators import spatial as sp


def frame(spark, polys):
    return spark.createDataFrame([(g, p, v, float(x), float(y)) for g, p, ring in polys for v, (x, y) in enumerate(ring)],
                                 "grp string, poly int, v int, x double, y double")


def found(union):
    rows = union.collect()
    out = collections.defaultdict(dict)
    for r in rows:
        out[r.grp, r.part, r.ring, r.hole][r.v] = (r.x, r.y)
    return {k: [p[i] for i in range(len(p))] for k, p in out.items()}


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def square(x, y, w=1, h=1):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


FULL = {(x, y) for x in range(5) for y in range(5)}
# cells taken from a full square, and the areas of the rings of what is left
CORNERS = [({(0, 0)}, [24.0]), ({(0, 1), (1, 0)}, [1.0, 22.0]), ({(1, 1)}, [-1.0, 25.0]), ({(0, 0), (1, 1)}, [-1.0, 24.0]),
           ({(1, 1), (2, 2)}, [-1.0, -1.0, 25.0]), ({(1, 1), (2, 2), (3, 3)}, [-1.0, -1.0, -1.0, 25.0])]
MOAT = [(x, y) for x in range(7) for y in range(7) if x in (0, 6) or y in (0, 6)]
RANDOM = random.Random(8)
CELLS = {(x, y) for x in range(6) for y in range(6) if RANDOM.random() < 0.55}
POLYS = [("a", 1, square(0, 0, 3, 1)), ("a", 2, square(0, 2, 3, 1)), ("a", 3, square(0, 1, 1, 1)), ("a", 4, square(2, 1, 1, 1)),   # frame
         ("a", 5, square(10, 0, 2, 2)), ("a", 6, square(12, 0.5, 1, 1)),                                                         # T junction
         ("b", 1, square(0, 0)[::-1])]                                                                                            # clockwise input
POLYS += [(f"corner{k}", 10 * x + y, square(x, y)) for k, (gone, _) in enumerate(CORNERS) for x, y in FULL - gone]
POLYS += [("moat", 10 * x + y, square(x, y)) for x, y in MOAT] + [("moat", 99, square(3, 3))]
POLYS += [("cells", 10 * x + y, square(x, y)) for x, y in CELLS]


@pytest.fixture(scope="module")
def union(spark):
    """The rings of all cases, made in one run: groups do not meet."""
    return rg.union_rings(frame(spark, POLYS), "grp", "poly", 1.0).checkpoint()


def rings_of(union, *groups):
    return {k: v for k, v in found(union).items() if k[0] in groups}


def test_hole_two_parts_and_t_junction(union):
    got = rings_of(union, "a", "b")
    assert {k: area(v) for k, v in got.items()} == {("a", 0, 0, False): 9, ("a", 0, 1, True): -1, ("a", 2, 2, False): 5, ("b", 0, 0, False): 1}
    assert {(12.0, 0.5), (12.0, 1.5)} <= set(got["a", 2, 2, False])
    assert all(ring[0] == min(ring) for ring in got.values())


def test_corners_that_touch(union):
    """Parts that share a corner are parts of their own; a hole that touches
    its outline is a ring of its own; holes that touch are several."""
    for k, (gone, want) in enumerate(CORNERS):
        got = rings_of(union, f"corner{k}")
        assert sorted(area(r) for r in got.values()) == sorted(want), gone
        assert all(len(set(r)) == len(r) for r in got.values())


def test_nested_island(union):
    got = rings_of(union, "moat")
    assert sorted((k[1] == k[2], k[3], area(v)) for k, v in got.items()) == [(False, True, -25.0), (True, False, 1.0), (True, False, 49.0)]
    hole = next(k for k in got if k[3])
    assert area(got[hole[0], hole[1], hole[1], False]) == 49


def test_random_lattice_feeds_covers(spark, union):
    """Area, outline and point tests of the rings equal those of the cells."""
    rows = union.where("grp = 'cells'")
    free = sum((x + dx, y + dy) not in CELLS for x, y in CELLS for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    measures = rg.part_measures(rows, "grp").collect()
    assert (sum(r.area for r in measures), sum(r.length for r in measures)) == (len(CELLS), free)
    edges = sp.ring_edges(rows.select("grp", "ring", "v", "x", "y"), "grp", "ring").select("grp", "x1", "y1", "x2", "y2").checkpoint()
    inner = [(10 * x + y, x + 0.2, y + 0.2, x + 0.7, y + 0.6) for x in range(6) for y in range(6)]
    segs = spark.createDataFrame(inner, "comid int, x1 double, y1 double, x2 double, y2 double")
    got = {r.comid for r in sp.covers_lines_edges(edges, "grp", segs, "comid", 1.0).collect()}
    assert got == {10 * x + y for x, y in CELLS}


def test_empty(spark):
    assert found(rg.union_rings(frame(spark, []), "grp", "poly", 1.0)) == {}


CONCAVE = [(0, 0), (6, 0), (6, 4), (4, 4), (4, 2), (2, 2), (2, 4), (0, 4)]


@pytest.fixture(scope="module")
def concave(spark):
    return sp.kept_edges(spark.createDataFrame([("u", v, float(x), float(y)) for v, (x, y) in enumerate(CONCAVE)],
                                               "area string, v int, x double, y double"), "area")


def clipped(spark, edges, lines):
    segs = spark.createDataFrame([(k, *map(float, s)) for k, s in enumerate(lines)], "comid int, x1 double, y1 double, x2 double, y2 double")
    out = collections.defaultdict(list)
    for r in sp.clip_lines(edges, "area", segs, "comid", 1.0).collect():
        out[r.comid].append(tuple(round(c, 9) for c in (r.x1, r.y1, r.x2, r.y2)))
    return {k: sorted(v) for k, v in out.items()}


def test_clip_at_concave_outline(spark, concave):
    lines = [(-1, 3, 7, 3),         # in, out at the notch, in again
             (1, 1, 5, 1),          # whole
             (3, 3, 3, 5),          # in the notch: nothing
             (-1, 2, 7, 2),         # along the notch's floor
             (-1, 4, 1, 4),         # along the top
             (-1, 0, 0, -1),        # beside a corner
             (-1, 1, 0, 0),         # touches a corner only
             (2, 3, 2, 5),          # along a side, then out
             (7, 7, 7, 7)]
    assert clipped(spark, concave, lines) == {
        0: [(0, 3, 2, 3), (4, 3, 6, 3)], 1: [(1, 1, 5, 1)], 3: [(0, 2, 6, 2)], 4: [(0, 4, 1, 4)], 7: [(2, 3, 2, 4)]}


def test_clip_against_samples(spark, concave):
    """Length of the kept pieces against the share of sampled points inside."""
    rng = random.Random(2)
    lines = [tuple(rng.uniform(-1, 7) for _ in range(4)) for _ in range(40)]
    got = clipped(spark, concave, lines)

    def inside(x, y):
        return 0 <= x <= 6 and 0 <= y <= 4 and not (2 < x < 4 and y > 2)

    for k, (x1, y1, x2, y2) in enumerate(lines):
        n = 4000
        share = sum(inside(x1 + (i + .5) / n * (x2 - x1), y1 + (i + .5) / n * (y2 - y1)) for i in range(n)) / n
        whole = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        kept = sum(((a - c) ** 2 + (b - d) ** 2) ** 0.5 for a, b, c, d in got.get(k, []))
        assert abs(kept / whole - share) < 2e-3


def test_flags_keep_every_covered_line(spark, concave):
    lines = [(1, (1.0, 1.0, 5.0, 1.0)), (2, (0.05, 1.0, 1.0, 1.0)), (3, (1.0, 1.0, 0.05, 1.0)), (4, (3.0, 3.0, 3.0, 5.0)), (5, (1.0, 1.0, 1.2, 1.1))]
    segs = spark.createDataFrame([(k, *s) for k, s in lines], "comid int, x1 double, y1 double, x2 double, y2 double")
    sinks = spark.createDataFrame([(k, s[2], s[3]) for k, s in lines if k != 5], "comid int, px double, py double")
    got = {(r.comid, r.boundary, r.outflow) for r in sp.outline_flags(concave, "area", segs, "comid", sinks, 0.1, 1.0).collect()}
    assert got == {(1, False, False), (2, True, False), (3, True, True)}
