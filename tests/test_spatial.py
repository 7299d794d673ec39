"""Spatial joins against brute force in plain Python, and the hard cases."""

import random

from tributary.operators import spatial as sp


def _orient(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on_box(a, b, c):
    return min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])


def _seg_hit(p1, p2, q1, q2):
    o1, o2, o3, o4 = _orient(p1, p2, q1), _orient(p1, p2, q2), _orient(q1, q2, p1), _orient(q1, q2, p2)
    if ((o1 > 0 > o2) or (o1 < 0 < o2)) and ((o3 > 0 > o4) or (o3 < 0 < o4)):
        return True
    return ((o1 == 0 and _on_box(p1, p2, q1)) or (o2 == 0 and _on_box(p1, p2, q2))
            or (o3 == 0 and _on_box(q1, q2, p1)) or (o4 == 0 and _on_box(q1, q2, p2)))


def _inside(pt, ring):
    c = 0
    for i in range(len(ring)):
        (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % len(ring)]
        if (y1 > pt[1]) != (y2 > pt[1]) and pt[0] < x1 + (pt[1] - y1) * (x2 - x1) / (y2 - y1):
            c += 1
    return c % 2 == 1


def _rings_df(spark, rings, name="pid", with_ring=False):
    rows = []
    for pid, rr in rings.items():
        for k, ring in enumerate(rr if with_ring else [rr]):
            rows += [(pid, k, v, float(x), float(y)) for v, (x, y) in enumerate(ring)]
    df = spark.createDataFrame(rows, f"{name} long, ring int, v int, x double, y double")
    return df if with_ring else df.drop("ring")


def test_random_lines_against_brute_force(spark):
    rnd = random.Random(11)
    polys = {}
    for pid in range(6):
        cx, cy, r = rnd.uniform(-5, 5), rnd.uniform(-5, 5), rnd.uniform(0.5, 3)
        pts = [(cx + r * dx, cy + r * dy) for dx, dy in [(-1, -0.7), (0.8, -1), (1, 0.6), (-0.5, 1.1), (-1.2, 0.3)]]
        polys[pid] = pts
    segs = [(i, rnd.uniform(-8, 8), rnd.uniform(-8, 8), rnd.uniform(-8, 8), rnd.uniform(-8, 8)) for i in range(300)]
    seg_df = spark.createDataFrame(segs, "sid long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.pid, r.sid) for r in sp.intersects_lines(_rings_df(spark, polys), "pid", seg_df, "sid", 0.7).collect()}
    want = set()
    for pid, ring in polys.items():
        for sid, x1, y1, x2, y2 in segs:
            edges = [(ring[i], ring[(i + 1) % len(ring)]) for i in range(len(ring))]
            if any(_seg_hit(a, b, (x1, y1), (x2, y2)) for a, b in edges) or _inside((x1, y1), ring):
                want.add((pid, sid))
    assert got == want and want


def test_touching_a_ring_vertex_counts(spark):
    poly = {1: [(0, 0), (2, 0), (2, 2), (0, 2)]}
    segs = spark.createDataFrame([(7, 2.0, 2.0, 3.0, 5.0), (8, 2.5, 0.0, 4.0, 1.0)],
                                 "sid long, x1 double, y1 double, x2 double, y2 double")
    got = {r.sid for r in sp.intersects_lines(_rings_df(spark, poly), "pid", segs, "sid", 1.0).collect()}
    assert got == {7}


def test_hole_is_outside(spark):
    rings = {1: [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)]]}
    df = _rings_df(spark, rings, with_ring=True)
    edges = sp.ring_edges(df, "pid", "ring").drop("ring")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 11.0, 5.0)], "q long, px double, py double")
    got = {r.q for r in sp.points_in_polygons(pts, "q", edges, "pid", 2.0).collect()}
    assert got == {2}


def test_covers_rejects_line_leaving_a_concave_polygon(spark):
    u_shape = {1: [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]}
    segs = spark.createDataFrame([(1, 1.0, 5.0, 5.0, 5.0), (2, 0.5, 1.0, 5.5, 1.0), (3, 0.0, 0.0, 6.0, 0.0)],
                                 "sid long, x1 double, y1 double, x2 double, y2 double")
    got = {r.sid for r in sp.covers_lines(_rings_df(spark, u_shape), "pid", segs, "sid", 1.0).collect()}
    assert got == {2, 3}   # 1 crosses the notch; 3 lies on the boundary


def test_long_segment_crosses_many_cells(spark):
    poly = {1: [(100, 100), (101, 100), (101, 101), (100, 101)]}
    segs = spark.createDataFrame([(1, -200.0, -200.0, 300.0, 300.0)], "sid long, x1 double, y1 double, x2 double, y2 double")
    assert sp.intersects_lines(_rings_df(spark, poly), "pid", segs, "sid", 0.5).count() == 1


def _squares(spark, squares):
    rows = [(0, i, v, float(x), float(y)) for i, (x0, y0, x1, y1) in enumerate(squares)
            for v, (x, y) in enumerate([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]
    return spark.createDataFrame(rows, "g long, pid long, v int, x double, y double")


def _unit_outline(squares, n):
    """Brute force on unit cells: unit edges with the union on one side only."""
    inside = {(x, y) for x0, y0, x1, y1 in squares for x in range(x0, x1) for y in range(y0, y1)}
    out = set()
    for x in range(-1, n + 1):
        for y in range(-1, n + 1):
            if ((x, y) in inside) != ((x, y - 1) in inside):
                out.add((x, y, x + 1, y))
            if ((x, y) in inside) != ((x - 1, y) in inside):
                out.add((x, y, x, y + 1))
    return out


def _as_units(edges):
    out = set()
    for r in edges:
        x1, y1, x2, y2 = (int(v) for v in (r.x1, r.y1, r.x2, r.y2))
        assert (x1, y1, x2, y2) == (r.x1, r.y1, r.x2, r.y2)
        for k in range(max(x2 - x1, y2 - y1)):
            dx, dy = (1, 0) if x2 > x1 else (0, 1)
            e = (x1 + k * dx, y1 + k * dy, x1 + (k + 1) * dx, y1 + (k + 1) * dy)
            assert e not in out
            out.add(e)
    return out


def test_dissolve_is_a_union(spark):
    """Shared sides of different length, overlaps, copies, containment, holes."""
    rnd = random.Random(4)
    cases = [[(0, 0, 2, 2), (2, 0, 4, 1)], [(0, 0, 3, 3), (1, 1, 4, 4)], [(0, 0, 2, 2), (0, 0, 2, 2)], [(0, 0, 5, 5), (1, 1, 3, 3)],
             [(0, 0, 4, 1), (0, 3, 4, 4), (0, 1, 1, 3), (3, 1, 4, 3)], [(0, 0, 1, 1), (1, 1, 2, 2)]]
    for _ in range(3):
        cases.append([(x, y, x + rnd.randint(1, 5), y + rnd.randint(1, 5)) for x, y in
                      [(rnd.randint(0, 9), rnd.randint(0, 9)) for _ in range(14)]])
    for squares in cases:
        got = sp.dissolve(_squares(spark, squares), "g", "pid", 2.0).collect()
        assert _as_units(got) == _unit_outline(squares, 16), squares


def test_dissolve_of_crossing_edges(spark):
    """Two slanted squares cross at computed points: the outline closes."""
    rows = [(0, p, v, x, y) for p, ring in enumerate([[(0, 0), (2, 0.3), (1.7, 2.2), (-0.2, 1.9)], [(1, 1), (3, 1.2), (2.8, 3.1), (0.9, 2.9)]])
            for v, (x, y) in enumerate(ring)]
    got = sp.dissolve(spark.createDataFrame([(*r[:3], float(r[3]), float(r[4])) for r in rows],
                                            "g long, pid long, v int, x double, y double"), "g", "pid", 1.0).collect()
    ends = {}
    for r in got:
        for p in ((r.x1, r.y1), (r.x2, r.y2)):
            ends[p] = ends.get(p, 0) + 1
    assert set(ends.values()) == {2} and len(got) == 8


def test_covers_stops_at_a_notch_that_the_line_touches(spark):
    """The line runs along the outline but leaves it over a notch."""
    ring = [(-1, -1), (1, -1), (1, 0), (1.5, 1), (2, 0), (2, -1), (11, -1), (11, 3), (-1, 3)]
    segs = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 2.0, 0.0, 10.0, 0.0), (3, 1.0, 0.0, 1.0, -1.0), (4, 1.5, 1.0, 1.5, 1.0),
                                  (5, 1.5, 0.5, 1.5, 0.5)], "sid long, x1 double, y1 double, x2 double, y2 double")
    got = {r.sid for r in sp.covers_lines(_rings_df(spark, {1: ring}), "pid", segs, "sid", 1.0).collect()}
    assert got == {2, 3, 4}


def test_covers_against_exact_arithmetic(spark):
    """Random concave polygons and lines on a small lattice (many touches),
    cut and tested with rational numbers."""
    from fractions import Fraction as Q
    rnd = random.Random(9)

    def on_ring(p, ring):
        return any(_orient(a, b, p) == 0 and _on_box(a, b, p) for a, b in zip(ring, ring[1:] + ring[:1]))

    def inside(p, ring):
        c = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + Q(p[1] - y1) * (x2 - x1) / (y2 - y1):
                c = not c
        return c

    def covered(p, q, ring):
        ts = {Q(0), Q(1)}
        for a, b in zip(ring, ring[1:] + ring[:1]):
            o1, o2 = _orient(a, b, p), _orient(a, b, q)
            if o1 != o2 and (o1 > 0) != (o2 > 0) or o1 == 0 or o2 == 0:
                if o1 != o2:
                    ts.add(Q(o1, o1 - o2))
            for v in (a, b):
                if _orient(p, q, v) == 0 and p != q:
                    k = 0 if p[0] != q[0] else 1
                    ts.add(Q(v[k] - p[k], q[k] - p[k]))
        ts = sorted(t for t in ts if 0 <= t <= 1)
        mids = [(a + b) / 2 for a, b in zip(ts, ts[1:])]
        return all(on_ring(m, ring) or inside(m, ring) for m in
                   [(p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])) for t in mids])

    rings = {1: [(0, 0), (8, 0), (8, 8), (6, 8), (6, 2), (4, 2), (4, 8), (2, 8), (2, 3), (0, 3)],
             2: [(0, 0), (4, 2), (8, 0), (6, 4), (8, 8), (4, 6), (0, 8), (2, 4)]}
    segs = [(i, rnd.randint(0, 8), rnd.randint(0, 8), rnd.randint(0, 8), rnd.randint(0, 8)) for i in range(250)]
    df = spark.createDataFrame([(i, *map(float, c)) for i, *c in segs], "sid long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.pid, r.sid) for r in sp.covers_lines(_rings_df(spark, rings), "pid", df, "sid", 1.5).collect()}
    want = {(pid, i) for pid, ring in rings.items() for i, a, b, c, d in segs if covered((a, b), (c, d), ring)}
    assert got == want and len(want) > 20


def test_large_polygon_takes_few_cells(spark):
    """Grid cells per polygon do not grow with its area."""
    big = _rings_df(spark, {1: [(0, 0), (1000, 0), (1000, 900), (0, 900)]})
    boxes = sp._ladder(sp._poly_boxes(sp.ring_edges(big, "pid"), ["pid"]), 0.5)
    assert boxes.count() <= 4
    pts = spark.createDataFrame([(1, 999.0, 1.0), (2, 1001.0, 5.0)], "q long, px double, py double")
    assert {r.q for r in sp.points_in_polygons(pts, "q", sp.ring_edges(big, "pid"), "pid", 0.5).collect()} == {1}


def test_near_boundary_distance(spark):
    poly = {1: [(0, 0), (4, 0), (4, 4), (0, 4)]}
    segs = spark.createDataFrame([(1, 2.0, 4.2, 3.0, 4.2), (2, 2.0, 4.3, 3.0, 4.3), (3, 1.0, 1.0, 2.0, 2.0)],
                                 "sid long, x1 double, y1 double, x2 double, y2 double")
    got = {r.sid for r in sp.near_boundary(_rings_df(spark, poly), "pid", segs, "sid", 0.25, 1.0).collect()}
    assert got == {1}


def _seg_dist2(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    l2 = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / l2)) if l2 > 0 else 0.0
    qx, qy = a[0] + t * dx, a[1] + t * dy
    return (p[0] - qx) ** 2 + (p[1] - qy) ** 2


def test_hot_cells_are_refined_and_exact(spark):
    """Many segments in one cell: its load divides it into sub-cells; the
    pairs found must equal brute force."""
    rnd = random.Random(7)
    a = [(i, rnd.uniform(0, 1), rnd.uniform(0, 1), rnd.uniform(0, 1), rnd.uniform(0, 1)) for i in range(60)]
    a += [(100 + i, rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for i in range(20)]
    b = [(i, rnd.uniform(0, 1), rnd.uniform(0, 1), rnd.uniform(0, 1), rnd.uniform(0, 1)) for i in range(40)]
    schema_a = "aid long, x1 double, y1 double, x2 double, y2 double"
    da = spark.createDataFrame(a, schema_a)
    db = spark.createDataFrame(b, schema_a.replace("aid", "bid"))
    got = {(r.aid, r.bid) for r in sp.segment_pairs(da, "aid", db, "bid", 1.0, pairs_per_key=10).collect()}
    want = {(ia, ib) for ia, *pa in a for ib, *pb in b
            if _seg_hit((pa[0], pa[1]), (pa[2], pa[3]), (pb[0], pb[1]), (pb[2], pb[3]))}
    assert got == want and len(want) > 50
    near = {(r.aid, r.bid) for r in sp.segment_pairs(da, "aid", db, "bid", 1.0, sp.stage_within(0.05), grow=0.05,
                                                     pairs_per_key=10).collect()}
    want_near = set()
    for ia, *pa in a:
        for ib, *pb in b:
            p1, p2, q1, q2 = (pa[0], pa[1]), (pa[2], pa[3]), (pb[0], pb[1]), (pb[2], pb[3])
            d = min(_seg_dist2(p1, q1, q2), _seg_dist2(p2, q1, q2), _seg_dist2(q1, p1, p2), _seg_dist2(q2, p1, p2))
            if _seg_hit(p1, p2, q1, q2) or d <= 0.05 * 0.05:
                want_near.add((ia, ib))
    assert near == want_near


def test_polygon_inside_polygon_and_multi_segment_line_inside(spark):
    """Containment is decided per test point: a small square inside a large
    polygon, and a two-segment line inside it, both intersect it."""
    big = _rings_df(spark, {1: [(0, 0), (10, 0), (10, 10), (0, 10)]}, name="aid")
    small = _rings_df(spark, {7: [(4, 4), (5, 4), (5, 5), (4, 5)], 8: [(20, 20), (21, 20), (21, 21), (20, 21)]},
                      name="bid")
    got = {(r.aid, r.bid) for r in sp.intersects_polygons(big, "aid", small, "bid", 2.0).collect()}
    assert got == {(1, 7)}
    segs = spark.createDataFrame([(3, 2.0, 2.0, 3.0, 3.0), (3, 3.0, 3.0, 4.0, 2.0)],
                                 "sid long, x1 double, y1 double, x2 double, y2 double")
    big_p = _rings_df(spark, {1: [(0, 0), (10, 0), (10, 10), (0, 10)]})
    assert {r.sid for r in sp.intersects_lines(big_p, "pid", segs, "sid", 2.0).collect()} == {3}
