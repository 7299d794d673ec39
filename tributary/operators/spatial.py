"""Planar spatial joins built from equi joins and arithmetic.

Geometry enters as tables of coordinates:

* segments ``(<id>, x1, y1, x2, y2)`` - a line is the set of its segments;
* polygon rings ``(<id>, [ring,] v, x, y)`` - vertices in ring order, the
  closing edge implied; holes are further rings (even-odd rule).

Candidate pairs come from a grid: every segment is cut into pieces no
longer than one cell, each piece names the (at most four) cells its box
touches, and pairs meet by an equi join on the cell key.  Cells per segment
grow linearly with its length.  A cell is divided by a factor that follows
from its own load, so a dense spot meets in many small keys.  Joins have no
explicit partitioning, so Spark splits what stays skewed.  Exact predicates
then run on the original coordinates:

* segment intersection by orientation signs (touching counts);
* point in polygon by ray casting, counted per polygon and horizontal band
  (edges are keyed by ``(polygon, band)``), odd crossings = inside; points
  find polygons on a ladder of grids, each polygon on the grid whose cells are
  about its size (at most four cells per polygon, whatever its area);
* segment distance as the least endpoint-to-segment distance.

Everything is DataFrame joins and aggregates; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root, shared_dir
from .joins import by_shuffle


# ---------------------------------------------------------------- predicates

def orient(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of ``abc``: > 0 left turn, < 0 right turn, 0 collinear."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _on_box(ax, ay, bx, by, cx, cy) -> Column:
    return (cx >= F.least(ax, bx)) & (cx <= F.greatest(ax, bx)) & (cy >= F.least(ay, by)) & (cy <= F.greatest(ay, by))


def point_on_segment(px, py, ax, ay, bx, by) -> Column:
    return (orient(ax, ay, bx, by, px, py) == 0) & _on_box(ax, ay, bx, by, px, py)


def point_segment_dist2(px, py, ax, ay, bx, by) -> Column:
    """Squared distance from point p to segment ab."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / len2))) \
         .otherwise(F.lit(0.0))
    qx, qy = ax + t * dx, ay + t * dy
    return (px - qx) * (px - qx) + (py - qy) * (py - qy)


# ---------------------------------------------------------------- geometry tables

def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back.  A checkpoint would
    carry each round's constraints into the next, and they double every round."""
    path = shared_dir(df.sparkSession, "rings")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ring_edges(rings: DataFrame, id_col: str, ring_col: str | None = None) -> DataFrame:
    """``(<id>, x1, y1, x2, y2)``: ring edges, closing edge included.

    Vertex ``v`` joins vertex ``(v + 1) mod n`` of the same ring (an equi
    join; ``n`` from a per-ring count), so no window holds a ring.
    """
    keys = [id_col] + ([ring_col] if ring_col else [])
    n = rings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    a = by_shuffle(rings).join(n, keys).select(*keys, F.col("v"), ((F.col("v") + 1) % F.col("_n")).alias("_next"),
                                   F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = rings.select(*keys, F.col("v").alias("_next"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return a.join(by_shuffle(b), keys + ["_next"]).select(*keys, "x1", "y1", "x2", "y2")


def segment_cells(segs: DataFrame, cell: float, grow: float = 0.0) -> DataFrame:
    """Add column ``cell`` (struct of grid indices) for every cell a segment
    may touch, its box grown by ``grow``.

    Each segment is cut into ``ceil(length / cell)`` pieces; a piece's box
    spans at most two cells per axis (plus the growth), so a segment
    yields O(length / cell) cell keys.
    """
    grow = grow + 1e-9 * cell  # rounding margin: pieces are interpolated
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pieces = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / cell).cast("int"))
    s = segs.withColumn("_k", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn("_np", pieces)
    t0, t1 = F.col("_k") / F.col("_np"), (F.col("_k") + 1) / F.col("_np")
    ax, ay = F.col("x1") + t0 * dx, F.col("y1") + t0 * dy
    bx, by = F.col("x1") + t1 * dx, F.col("y1") + t1 * dy
    lo_x = F.floor((F.least(ax, bx) - grow) / cell)
    hi_x = F.floor((F.greatest(ax, bx) + grow) / cell)
    lo_y = F.floor((F.least(ay, by) - grow) / cell)
    hi_y = F.floor((F.greatest(ay, by) + grow) / cell)
    s = s.withColumns({"_pax": ax, "_pay": ay, "_pbx": bx, "_pby": by})
    s = (s.withColumn("_cx", F.explode(F.sequence(lo_x, hi_x)))
          .withColumn("_cy", F.explode(F.sequence(lo_y, hi_y))))
    return s.withColumn("cell", F.struct("_cx", "_cy")).drop("_k", "_np", "_cx", "_cy")


def _cells_as(df: DataFrame, ids: list[str], p: str, cell: float, grow: float) -> DataFrame:
    c = segment_cells(df.select(*ids, "x1", "y1", "x2", "y2"), cell, grow)
    return c.select(*ids, "cell", "_pax", "_pay", "_pbx", "_pby",
                    *[F.col(k).alias(f"{p}{k}") for k in ["x1", "y1", "x2", "y2"]])


# Fixed value: candidate pairs that one key should produce.
PAIRS_PER_KEY = 10_000


def _divided(c: DataFrame, load: DataFrame, by: list[str], cell: float, grow: float) -> DataFrame:
    """Rows of the cells of ``load``, keyed by sub-cell (``sub``): the
    piece is cut at ``cell / k``, ``k`` being the cell's own divisor."""
    c = c.join(load, [*by, "cell"])
    size = F.lit(cell) / F.col("_div")
    g = F.lit(grow) + F.lit(1e-9) * size
    dx, dy = F.col("_pbx") - F.col("_pax"), F.col("_pby") - F.col("_pay")
    m = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / size).cast("int"))
    r = c.withColumn("_m", m).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    u0, u1 = F.col("_j") / F.col("_m"), (F.col("_j") + 1) / F.col("_m")
    r = r.withColumns({"_nax": F.col("_pax") + u0 * dx, "_nay": F.col("_pay") + u0 * dy,
                       "_nbx": F.col("_pax") + u1 * dx, "_nby": F.col("_pay") + u1 * dy})
    for axis, lo, hi, own in (("_sx", "_nax", "_nbx", "cell._cx"), ("_sy", "_nay", "_nby", "cell._cy")):
        first = F.greatest(F.floor((F.least(lo, hi) - g) / size), F.col(own) * F.col("_div"))
        last = F.least(F.floor((F.greatest(lo, hi) + g) / size), (F.col(own) + 1) * F.col("_div") - 1)
        r = r.withColumn(axis, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return r.withColumn("sub", F.struct("_sx", "_sy")).drop(
        "_m", "_j", "_nax", "_nay", "_nbx", "_nby", "_sx", "_sy", "_div", "_pax", "_pay", "_pbx", "_pby")


def candidate_segments(a: DataFrame, a_ids: list[str], b: DataFrame, b_ids: list[str], cell: float, grow: float = 0.0,
                       by: list[str] | None = None, pairs_per_key: int = PAIRS_PER_KEY) -> DataFrame:
    """Pairs of segments that come near each other: the ids and coordinates
    (``a_*``, ``b_*``) of both; a pair may appear once per key it shares.
    ``by``: columns that both sides have and that must be equal."""
    by = by or []
    ca = _cells_as(a, [*by, *a_ids], "a_", cell, grow)
    cb = _cells_as(b, [*by, *b_ids], "b_", cell, grow)
    na = ca.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("_na"))
    nb = cb.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("_nb"))
    div = F.greatest(F.lit(1), F.ceil(F.pow(F.col("_na") * F.col("_nb") / F.lit(float(pairs_per_key)), F.lit(0.25)))).cast("long")
    # the few dense cells, written: Spark sees how small they are and the others meet by one shuffle
    load = kept(na.join(nb, [*by, "cell"]).select(*by, "cell", div.alias("_div")).where("_div > 1"))
    return _keyed(ca, load, by, cell, grow).join(_keyed(cb, load, by, cell, grow), [*by, "cell", "sub"]).drop("cell", "sub")


def _keyed(c: DataFrame, load: DataFrame, by: list[str], cell: float, grow: float) -> DataFrame:
    """Rows with their sub-cell: of dense cells (``load``) by :func:`_divided`, of others the cell."""
    sub = F.struct(F.col("cell._cx").alias("_sx"), F.col("cell._cy").alias("_sy"))
    same = [F.col(x).eqNullSafe(F.col(f"_l_{x}")) for x in [*by, "cell"]]
    light = c.join(load.select(*[F.col(x).alias(f"_l_{x}") for x in [*by, "cell"]]), same, "left_anti") \
        .withColumn("sub", sub).drop("_pax", "_pay", "_pbx", "_pby")
    return light.unionByName(_divided(c, load, by, cell, grow))


_A = ["a_x1", "a_y1", "a_x2", "a_y2"]
_B = ["b_x1", "b_y1", "b_x2", "b_y2"]


def _with_orients(j: DataFrame) -> DataFrame:
    """Stage the four orientations of a candidate pair as columns (each computed once)."""
    p1x, p1y, p2x, p2y = (F.col(c) for c in _A)
    q1x, q1y, q2x, q2y = (F.col(c) for c in _B)
    return j.withColumns({
        "_o1": orient(p1x, p1y, p2x, p2y, q1x, q1y), "_o2": orient(p1x, p1y, p2x, p2y, q2x, q2y),
        "_o3": orient(q1x, q1y, q2x, q2y, p1x, p1y), "_o4": orient(q1x, q1y, q2x, q2y, p2x, p2y)})


def _proper_from_orients() -> Column:
    o1, o2, o3, o4 = (F.col(c) for c in ["_o1", "_o2", "_o3", "_o4"])
    return (((o1 > 0) & (o2 < 0)) | ((o1 < 0) & (o2 > 0))) & (((o3 > 0) & (o4 < 0)) | ((o3 < 0) & (o4 > 0)))


def _intersect_from_orients() -> Column:
    p1x, p1y, p2x, p2y = (F.col(c) for c in _A)
    q1x, q1y, q2x, q2y = (F.col(c) for c in _B)
    o1, o2, o3, o4 = (F.col(c) for c in ["_o1", "_o2", "_o3", "_o4"])
    touch = (((o1 == 0) & _on_box(p1x, p1y, p2x, p2y, q1x, q1y))
             | ((o2 == 0) & _on_box(p1x, p1y, p2x, p2y, q2x, q2y))
             | ((o3 == 0) & _on_box(q1x, q1y, q2x, q2y, p1x, p1y))
             | ((o4 == 0) & _on_box(q1x, q1y, q2x, q2y, p2x, p2y)))
    return _proper_from_orients() | touch


def stage_intersects(j: DataFrame) -> DataFrame:
    """Keep candidate pairs whose segments share a point."""
    return _with_orients(j).where(_intersect_from_orients())


def stage_proper(j: DataFrame) -> DataFrame:
    """Keep candidate pairs whose segments cross at interior points."""
    return _with_orients(j).where(_proper_from_orients())


def stage_within(d: float):
    """Keep candidate pairs at most ``d`` apart (intersecting, or an endpoint near the other segment)."""
    def run(j: DataFrame) -> DataFrame:
        p1x, p1y, p2x, p2y = (F.col(c) for c in _A)
        q1x, q1y, q2x, q2y = (F.col(c) for c in _B)
        j = _with_orients(j).withColumns({
            "_d1": point_segment_dist2(p1x, p1y, q1x, q1y, q2x, q2y),
            "_d2": point_segment_dist2(p2x, p2y, q1x, q1y, q2x, q2y),
            "_d3": point_segment_dist2(q1x, q1y, p1x, p1y, p2x, p2y),
            "_d4": point_segment_dist2(q2x, q2y, p1x, p1y, p2x, p2y)})
        near = F.least("_d1", "_d2", "_d3", "_d4") <= F.lit(float(d) * float(d))
        return j.where(_intersect_from_orients() | near)
    return run


def segment_pairs(a: DataFrame, a_id: str, b: DataFrame, b_id: str, cell: float, predicate=None,
                  grow: float = 0.0, pairs_per_key: int = PAIRS_PER_KEY) -> DataFrame:
    """Distinct ``(a_id, b_id)`` with some segment of a and some segment of b
    passing ``predicate`` (a staged filter; default :func:`stage_intersects`)."""
    stage = predicate or stage_intersects
    return stage(candidate_segments(a, [a_id], b, [b_id], cell, grow, pairs_per_key=pairs_per_key)).select(a_id, b_id).distinct()


def _poly_boxes(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.groupBy(*keys).agg(F.min(F.least("x1", "x2")).alias("_xmin"), F.max(F.greatest("x1", "x2")).alias("_xmax"),
                                    F.min(F.least("y1", "y2")).alias("_ymin"), F.max(F.greatest("y1", "y2")).alias("_ymax"))


def _ladder(boxes: DataFrame, cell: float) -> DataFrame:
    """Each box on the grid ``cell * 2^rung`` that is at least its size: at most four cells."""
    side = F.greatest(F.col("_xmax") - F.col("_xmin"), F.col("_ymax") - F.col("_ymin"))
    rung = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(cell)) / cell))).cast("int")
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("rung"))
    return (boxes.withColumn("rung", rung)
                 .withColumn("gx", F.explode(F.sequence(F.floor(F.col("_xmin") / size), F.floor(F.col("_xmax") / size))))
                 .withColumn("gy", F.explode(F.sequence(F.floor(F.col("_ymin") / size), F.floor(F.col("_ymax") / size)))))


def _ray_cast(cand: DataFrame, keys: list[str], pt_id: str, edges: DataFrame, cell: float, boundary: bool) -> DataFrame:
    """The pairs (polygon ``keys``, ``pt_id``) of ``cand`` whose point (px, py) is inside."""
    lo, hi = F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell)
    bands = edges.select(*keys, "x1", "y1", "x2", "y2").withColumn("_band", F.explode(F.sequence(lo, hi)))
    j = cand.withColumn("_band", F.floor(F.col("py") / cell)).join(bands, [*keys, "_band"])
    x1, y1, x2, y2, px, py = (F.col(c) for c in ["x1", "y1", "x2", "y2", "px", "py"])
    spans = (y1 > py) != (y2 > py)
    crosses = spans & (px < F.when(spans, x1 + (py - y1) * (x2 - x1) / (y2 - y1)))
    on_edge = point_on_segment(px, py, x1, y1, x2, y2)
    agg = j.groupBy(pt_id, *keys).agg(F.count_if(crosses).alias("_nc"), F.max(on_edge.cast("int")).alias("_on"))
    keep = (F.col("_nc") % 2 == 1)
    if boundary:
        keep = keep | (F.col("_on") == 1)
    return agg.where(keep).select(pt_id, *keys)


def box_candidates(points: DataFrame, pt_id: str, edges: DataFrame, keys: list[str], cell: float,
                   by: list[str] | None = None) -> DataFrame:
    """``(pt_id, keys, px, py)`` where the point lies in the polygon's box;
    points are looked up once per rung in use.  ``by``: columns of ``keys``
    that points have too and that must be equal."""
    by = by or []
    boxes = _ladder(_poly_boxes(edges, keys), cell)
    top = boxes.agg(F.max("rung")).scalar()
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("rung"))
    pc = (points.withColumn("rung", F.explode(F.sequence(F.lit(0), F.coalesce(top, F.lit(0)))))
                .withColumn("gx", F.floor(F.col("px") / size)).withColumn("gy", F.floor(F.col("py") / size)))
    cand = by_shuffle(pc).join(boxes, [*by, "rung", "gx", "gy"]).where(
        F.col("px").between(F.col("_xmin"), F.col("_xmax")) & F.col("py").between(F.col("_ymin"), F.col("_ymax")))
    return cand.select(pt_id, *keys, "px", "py")


def points_in_polygons(points: DataFrame, pt_id: str, edges: DataFrame, poly_id: str, cell: float,
                       boundary: bool = False) -> DataFrame:
    """Distinct ``(pt_id, poly_id)`` with the point inside the polygon (even-odd);
    with ``boundary=True`` points on an edge count as inside.

    Points meet the polygons whose box holds them (equi join on a ladder cell),
    then the polygon's edges of the point's band (equi join on polygon and band).
    """
    return _ray_cast(box_candidates(points, pt_id, edges, [poly_id], cell), [poly_id], pt_id, edges, cell, boundary)


# ---------------------------------------------------------------- joins

def kept_edges(rings: DataFrame, poly_id: str, ring_col: str | None = None) -> DataFrame:
    """Ring edges, made once per query (reliable checkpoint): every step of a
    spatial join reads them."""
    checkpoint_root(rings.sparkSession)
    return ring_edges(rings, poly_id, ring_col).checkpoint()


def intersects_lines(polys: DataFrame, poly_id: str, segs: DataFrame, line_id: str, cell: float) -> DataFrame:
    """``(poly_id, line_id)`` for every line meeting a polygon.

    A line meets a polygon when one of its segments meets a ring edge, or -
    if it crosses no edge - when one of its vertices lies inside.
    """
    edges = kept_edges(polys, poly_id)
    crossing = segment_pairs(edges, poly_id, segs, line_id, cell)
    # One test point per segment start; each point is counted on its own.
    pts = (segs.select(line_id, F.col("x1").alias("px"), F.col("y1").alias("py")).distinct()
               .withColumn("_pt", F.struct(line_id, "px", "py")))
    inside = points_in_polygons(pts, "_pt", edges, poly_id, cell)
    return crossing.unionByName(inside.select(poly_id, F.col(f"_pt.{line_id}").alias(line_id))).distinct()


def intersects_polygons(a: DataFrame, a_id: str, b: DataFrame, b_id: str, cell: float) -> DataFrame:
    """``(a_id, b_id)`` for every pair of polygons that share a point (J6):
    ring edges meet, or a vertex of one lies inside the other."""
    ea, eb = kept_edges(a, a_id), kept_edges(b, b_id)
    crossing = segment_pairs(ea, a_id, eb, b_id, cell)
    # Each vertex is its own test point (keyed by polygon and vertex number).
    va = a.select(F.struct(a_id, "v").alias("_pt"), F.col("x").alias("px"), F.col("y").alias("py"))
    vb = b.select(F.struct(b_id, "v").alias("_pt"), F.col("x").alias("px"), F.col("y").alias("py"))
    b_in_a = points_in_polygons(vb, "_pt", ea, a_id, cell).select(a_id, F.col(f"_pt.{b_id}").alias(b_id))
    a_in_b = points_in_polygons(va, "_pt", eb, b_id, cell).select(F.col(f"_pt.{a_id}").alias(a_id), b_id)
    return crossing.unionByName(b_in_a).unionByName(a_in_b).distinct()


# Fixed value: pieces of a segment shorter than this share of it are rounding.
TINY = 1e-9


def _along(px: Column, py: Column) -> Column:
    """Position of a point on segment b, 0 at its start and 1 at its end."""
    x1, y1, x2, y2 = (F.col(c) for c in _B)
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    return F.when(len2 > 0, ((px - x1) * dx + (py - y1) * dy) / F.nullif(len2, F.lit(0.0))).otherwise(F.lit(0.0))


def covers_lines(polys: DataFrame, poly_id: str, segs: DataFrame, line_id: str, cell: float) -> DataFrame:
    """``(poly_id, line_id)`` where the polygon covers the whole line."""
    return covers_lines_edges(kept_edges(polys, poly_id), poly_id, segs, line_id, cell)


def _contacts(edges: DataFrame, poly_id: str, s: DataFrame, line_id: str, cell: float) -> DataFrame:
    """``(poly_id, line_id, seg, t, runs)`` for every segment that meets the
    outline: ``t`` the sorted places of its contacts (0 and 1 included),
    ``runs`` the stretches along the outline."""
    p1x, p1y, p2x, p2y = (F.col(c) for c in _A)
    q1x, q1y, q2x, q2y = (F.col(c) for c in _B)
    o1, o2, o3, o4 = (F.col(c) for c in ["_o1", "_o2", "_o3", "_o4"])
    hit = stage_intersects(candidate_segments(edges, [poly_id], s, [line_id], cell))
    point = (q1x == q2x) & (q1y == q2y)
    ta, tb = _along(p1x, p1y), _along(p2x, p2y)
    cuts = F.array_compact(F.array(
        F.when(_proper_from_orients(), o1 / F.nullif(o1 - o2, F.lit(0.0))),
        F.when((o3 == 0) & _on_box(q1x, q1y, q2x, q2y, p1x, p1y), ta),
        F.when((o4 == 0) & _on_box(q1x, q1y, q2x, q2y, p2x, p2y), tb)))
    run = F.when((o1 == 0) & (o2 == 0), F.when(point, F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))).otherwise(
        F.struct(F.least(ta, tb).alias("lo"), F.greatest(ta, tb).alias("hi"))))
    seg = F.struct(*[F.col(c).alias(c[2:]) for c in _B]).alias("seg")
    return hit.select(poly_id, line_id, seg, cuts.alias("cuts"), run.alias("run")).groupBy(poly_id, line_id, "seg").agg(
        F.array_sort(F.array_distinct(F.flatten(F.array(F.array(F.lit(0.0), F.lit(1.0)), F.flatten(F.collect_list("cuts")))))).alias("t"),
        F.collect_set("run").alias("runs"))


def _pieces(met: DataFrame, poly_id: str, line_id: str) -> DataFrame:
    """The pieces ``p`` (lo, hi) between contacts, and whether they run ``along`` the outline."""
    pieces = met.select(poly_id, line_id, "seg", "runs", F.explode(F.expr(
        "transform(sequence(1, size(t) - 1), i -> struct(t[i - 1] as lo, t[i] as hi))")).alias("p"))
    along = F.exists("runs", lambda r: (r["lo"] <= F.col("p.lo") + TINY) & (F.col("p.hi") <= r["hi"] + TINY))
    return pieces.where(F.col("p.hi") - F.col("p.lo") > TINY).select(poly_id, line_id, "seg", "p", along.alias("along"))


def _middles(pieces: DataFrame, poly_id: str, line_id: str) -> DataFrame:
    """The middle of each piece as a test point ``_pt`` (line, seg, t)."""
    mid = (F.col("p.lo") + F.col("p.hi")) / 2
    return pieces.select(poly_id, F.struct(line_id, "seg", mid.alias("t")).alias("_pt"),
                         (F.col("seg.x1") + mid * (F.col("seg.x2") - F.col("seg.x1"))).alias("px"),
                         (F.col("seg.y1") + mid * (F.col("seg.y2") - F.col("seg.y1"))).alias("py"), "p")


def covers_lines_edges(edges: DataFrame, poly_id: str, segs: DataFrame, line_id: str, cell: float) -> DataFrame:
    """Covers for outlines given as edges (holes and several parts by the
    even-odd rule).

    Each segment is cut at all its contacts with the outline; it is covered if
    every piece runs along the outline or has its midpoint inside.  A segment
    without contact is covered if its start is inside.
    """
    s = segs.select(line_id, "x1", "y1", "x2", "y2").distinct()
    met = _contacts(edges, poly_id, s, line_id, cell)
    open_ = _middles(_pieces(met, poly_id, line_id).where(~F.col("along")), poly_id, line_id).drop("p")
    inside = _ray_cast(open_, [poly_id], "_pt", edges, cell, False)
    bad = open_.join(inside, [poly_id, "_pt"], "left_anti").select(
        poly_id, F.col(f"_pt.{line_id}").alias(line_id), F.col("_pt.seg").alias("seg")).distinct()
    touched = met.select(poly_id, line_id, "seg")
    whole = s.select(line_id, F.struct("x1", "y1", "x2", "y2").alias("seg"))
    starts = whole.select(F.struct(line_id, "seg").alias("_pt"), F.col("seg.x1").alias("px"), F.col("seg.y1").alias("py"))
    free = points_in_polygons(starts, "_pt", edges, poly_id, cell).select(
        poly_id, F.col(f"_pt.{line_id}").alias(line_id), F.col("_pt.seg").alias("seg")).join(touched, [poly_id, line_id, "seg"], "left_anti")
    covered = free.unionByName(touched.join(bad, [poly_id, line_id, "seg"], "left_anti"))
    need = s.groupBy(line_id).agg(F.count(F.lit(1)).alias("_need"))
    return covered.groupBy(poly_id, line_id).agg(F.count(F.lit(1)).alias("_got")).join(need, line_id) \
        .where(F.col("_got") == F.col("_need")).select(poly_id, line_id)


def clip_lines(edges: DataFrame, poly_id: str, segs: DataFrame, line_id: str, cell: float) -> DataFrame:
    """``(poly_id, line_id, x1, y1, x2, y2)``: what of each segment lies in the
    polygon or on its outline (S18), given as edges (holes by even-odd).

    A segment is cut at all its contacts; pieces along the outline or with
    their middle inside stay, and pieces that follow each other are one.  A
    segment without contact stays whole if its start is inside; one that
    only touches the outline leaves nothing.
    """
    s = segs.select(line_id, "x1", "y1", "x2", "y2").distinct()
    met = _contacts(edges, poly_id, s, line_id, cell)
    pieces = _middles(_pieces(met, poly_id, line_id), poly_id, line_id)
    along = _pieces(met, poly_id, line_id).where("along").select(poly_id, line_id, "seg", "p")
    inside = _ray_cast(pieces.drop("p"), [poly_id], "_pt", edges, cell, False)
    kept = pieces.join(inside, [poly_id, "_pt"]).select(poly_id, F.col(f"_pt.{line_id}").alias(line_id), F.col("_pt.seg").alias("seg"), "p") \
        .unionByName(along).groupBy(poly_id, line_id, "seg").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    # neighbours that touch are joined; the list of one segment's pieces in one polygon is as long as its contacts
    joined = F.aggregate("ps", F.expr("cast(array() as array<struct<lo:double,hi:double>>)"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["hi"] >= x["lo"] - TINY),
        F.concat(F.slice(acc, 1, F.size(acc) - 1),
                 F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), F.greatest(F.element_at(acc, -1)["hi"], x["hi"]).alias("hi")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))))))
    cut = kept.select(poly_id, line_id, "seg", F.explode(joined).alias("p"))

    def place(t: Column, axis: str) -> Column:
        # ends that no contact moved keep their own coordinates
        first, last = F.col(f"seg.{axis}1"), F.col(f"seg.{axis}2")
        return F.when(t == 0, first).when(t == 1, last).otherwise(first + t * (last - first))

    cut = cut.select(poly_id, line_id, place(F.col("p.lo"), "x").alias("x1"), place(F.col("p.lo"), "y").alias("y1"),
                     place(F.col("p.hi"), "x").alias("x2"), place(F.col("p.hi"), "y").alias("y2"))
    whole = s.select(line_id, F.struct("x1", "y1", "x2", "y2").alias("seg"))
    starts = whole.select(F.struct(line_id, "seg").alias("_pt"), F.col("seg.x1").alias("px"), F.col("seg.y1").alias("py"))
    free = points_in_polygons(starts, "_pt", edges, poly_id, cell).select(
        poly_id, F.col(f"_pt.{line_id}").alias(line_id), F.col("_pt.seg").alias("seg")) \
        .join(met.select(poly_id, line_id, "seg"), [poly_id, line_id, "seg"], "left_anti")
    return cut.unionByName(free.select(poly_id, line_id, "seg.*"))


def outline_flags(edges: DataFrame, poly_id: str, segs: DataFrame, line_id: str, sinks: DataFrame, d: float, cell: float) -> DataFrame:
    """``(poly_id, line_id, boundary, outflow)`` for every line that a polygon
    covers (J9): ``boundary`` if the line comes within ``d`` of the outline,
    ``outflow`` if its sink ``(line_id, px, py)`` does.  Lines without a sink
    have no row, as in the join with their nexus.

    Both flags are existence joins that keep every covered line: the near
    pairs are distinct, so a line has one row a polygon.
    """
    covered = covers_lines_edges(edges, poly_id, segs, line_id, cell)
    checkpoint_root(edges.sparkSession)
    covered = covered.join(sinks.select(line_id, F.col("px").alias("_sx"), F.col("py").alias("_sy")), line_id).checkpoint()
    own = segs.join(covered.select(line_id).distinct(), line_id, "left_semi")
    ends = covered.select(line_id, F.col("_sx").alias("x1"), F.col("_sy").alias("y1"), F.col("_sx").alias("x2"), F.col("_sy").alias("y2")).distinct()
    near = near_edges(edges, poly_id, own, line_id, d, cell).withColumn("boundary", F.lit(True))
    out = near_edges(edges, poly_id, ends, line_id, d, cell).withColumn("outflow", F.lit(True))
    return covered.select(poly_id, line_id).join(near, [poly_id, line_id], "left").join(out, [poly_id, line_id], "left").select(
        poly_id, line_id, F.coalesce("boundary", F.lit(False)).alias("boundary"), F.coalesce("outflow", F.lit(False)).alias("outflow"))


def near_boundary(polys: DataFrame, poly_id: str, segs: DataFrame, line_id: str, d: float, cell: float) -> DataFrame:
    """``(poly_id, line_id)`` for lines within ``d`` of the polygon outline."""
    return near_edges(kept_edges(polys, poly_id), poly_id, segs, line_id, d, cell)


def near_edges(edges: DataFrame, poly_id: str, segs: DataFrame, line_id: str, d: float, cell: float) -> DataFrame:
    """Lines (or points, as segments without length) within ``d`` of an outline given as edges."""
    return segment_pairs(edges, poly_id, segs, line_id, cell, stage_within(d), grow=d)


def dissolve(rings: DataFrame, group: str, poly_id: str, cell: float) -> DataFrame:
    """Outline of the union of each group's simple polygons (A20), as
    undirected edges ``(group, x1, y1, x2, y2)``; :mod:`.rings` makes rings of them.
    """
    return union_walls(rings, group, poly_id, cell).drop("left")


def union_walls(rings: DataFrame, group: str, poly_id: str, cell: float) -> DataFrame:
    """The edges of :func:`dissolve` from their lesser to their greater end,
    with ``left``: whether the union lies on their left side.

    Every edge is cut where others of its group meet it.  Of equal pieces only
    those stay that have the inside on one side alone, and of these only
    pieces that do not lie inside another polygon of the group.
    """
    checkpoint_root(rings.sparkSession)
    keyed = rings.withColumn("_poly", F.struct(group, poly_id))
    edges = ring_edges(keyed.select("_poly", "v", "x", "y"), "_poly")
    turn = edges.groupBy("_poly").agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("_area"))
    edges = edges.join(turn, "_poly").select(F.col(f"_poly.{group}").alias(group), F.col(f"_poly.{poly_id}").alias(poly_id),
                                             "x1", "y1", "x2", "y2", (F.col("_area") > 0).alias("_left")).checkpoint()
    flat = kept(edges.select(group, "x1", "y1", "x2", "y2").distinct())
    met = stage_intersects(candidate_segments(flat, [], flat, [], cell, by=[group]))
    met = met.where(~((F.col("a_x1") == F.col("b_x1")) & (F.col("a_y1") == F.col("b_y1"))
                      & (F.col("a_x2") == F.col("b_x2")) & (F.col("a_y2") == F.col("b_y2"))))
    a, b = (F.struct(*[F.col(c).alias(c[2:]) for c in side]) for side in (_A, _B))
    first, second = F.least(a, b), F.greatest(a, b)      # one order, so both edges get the same crossing point
    f1x, f1y, f2x, f2y = (first[c] for c in ("x1", "y1", "x2", "y2"))
    s1x, s1y, s2x, s2y = (second[c] for c in ("x1", "y1", "x2", "y2"))
    u1, u2 = orient(s1x, s1y, s2x, s2y, f1x, f1y), orient(s1x, s1y, s2x, s2y, f2x, f2y)
    t = u1 / F.nullif(u1 - u2, F.lit(0.0))
    p1x, p1y, p2x, p2y = (F.col(c) for c in _A)
    q1x, q1y, q2x, q2y = (F.col(c) for c in _B)

    def place(x, y):
        return F.struct(_along(x, y).alias("t"), x.alias("x"), y.alias("y"))

    cuts = F.array_compact(F.array(
        F.when(_proper_from_orients(), place(f1x + t * (f2x - f1x), f1y + t * (f2y - f1y))),
        F.when((F.col("_o3") == 0) & _on_box(q1x, q1y, q2x, q2y, p1x, p1y), place(p1x, p1y)),
        F.when((F.col("_o4") == 0) & _on_box(q1x, q1y, q2x, q2y, p2x, p2y), place(p2x, p2y))))
    by_edge = met.select(group, *[F.col(c).alias(c[2:]) for c in _B], F.explode(cuts).alias("cut")) \
        .where((F.col("cut.t") > 0) & (F.col("cut.t") < 1)).groupBy(group, "x1", "y1", "x2", "y2").agg(F.collect_set("cut").alias("cuts"))
    ends = F.array(F.struct(F.lit(0.0).alias("t"), F.col("x1").alias("x"), F.col("y1").alias("y")),
                   F.struct(F.lit(1.0).alias("t"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    marks = F.array_sort(F.concat(ends, F.coalesce("cuts", F.array().cast("array<struct<t:double,x:double,y:double>>"))))
    pieces = edges.join(by_edge, [group, "x1", "y1", "x2", "y2"], "left").withColumn("m", marks).select(
        group, poly_id, "_left", F.explode(F.expr("transform(sequence(1, size(m) - 1), i -> struct(m[i - 1] as a, m[i] as b))")).alias("p"))
    forward = (F.col("p.a.x") < F.col("p.b.x")) | ((F.col("p.a.x") == F.col("p.b.x")) & (F.col("p.a.y") <= F.col("p.b.y")))
    lo, hi = F.when(forward, F.col("p.a")).otherwise(F.col("p.b")), F.when(forward, F.col("p.b")).otherwise(F.col("p.a"))
    pieces = pieces.select(group, poly_id, lo["x"].alias("x1"), lo["y"].alias("y1"), hi["x"].alias("x2"), hi["y"].alias("y2"),
                           (F.col("_left") == forward).alias("_left")) \
        .where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))).checkpoint()
    key = [group, "x1", "y1", "x2", "y2"]
    walls = pieces.groupBy(*key).agg(F.max("_left").alias("l"), F.min("_left").alias("r")).where(F.col("l") == F.col("r")).select(*key, F.col("l").alias("left"))
    mids = walls.select(group, F.struct(*key).alias("_pt"), ((F.col("x1") + F.col("x2")) / 2).alias("px"),
                        ((F.col("y1") + F.col("y2")) / 2).alias("py"))
    near = box_candidates(mids, "_pt", edges, [group, poly_id], cell, by=[group])
    others = near.join(pieces.select(group, poly_id, F.struct(*key).alias("_pt")).distinct(), [group, poly_id, "_pt"], "left_anti")
    hidden = _ray_cast(others, [group, poly_id], "_pt", edges, cell, False).select("_pt.*").distinct()
    return walls.join(hidden, key, "left_anti")


def bounds(points: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """Bounding box per geometry."""
    return points.groupBy(key).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"),
                                   F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def box_corners(boxes: DataFrame, key: str) -> DataFrame:
    """Corners of each box ``(key, v, x, y)``, from the lower left
    counter-clockwise, ``v`` from 0 (F17)."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"))
    return boxes.select(key, F.posexplode(ring).alias("v", "p")).select(key, "v", "p.x", "p.y")
