"""Named spatial queries: watersheds x reach lines, polygon overlays, dissolve,
bounds, bounding-box selection, coordinate transforms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.time import partial_label
from ..operators import rings as rg
from ..operators import spatial as sp
from ..sources import fixtures as fx
from . import spatial_sql as q
from .common import rounded
from .registry import query

# Grid cell of the candidate joins (about the median segment
# length of the two layers; results do not depend on it), distance of the "near the
# outline" test, the bounding box and day of the grid selection, and the
# mapping of segment coordinates to degrees for the projections.
CELL = 2.0
NEAR = 0.25
BBOX_X = (10.0, 60.0)
BBOX_Y = (2.0, 6.0)
BBOX_DAY = "2024-01-15"
LON_0, LON_SCALE = -96.0, 2.0
LAT_0, LAT_SCALE = 38.0, 2.0

_AE = f"ae AS {q.ring_edges('areas', 'area_id')}"
_SEG = ("s.x1", "s.y1", "s.x2", "s.y2")
_EDGE = ("ae.x1", "ae.y1", "ae.x2", "ae.y2")


@query("q_spatial_intersects", f"""
WITH {_AE},
hit AS (SELECT DISTINCT ae.area_id, s.comid FROM ae, seg s WHERE {q.intersects(*_EDGE, *_SEG)}),
ins AS (SELECT ae.area_id, s.comid FROM ae, seg s GROUP BY 1, 2
        HAVING sum({q.crossing('s.x1', 's.y1', *_EDGE)}) % 2 = 1)
SELECT area_id, comid FROM hit UNION SELECT area_id, comid FROM ins""")
def q_spatial_intersects(spark, root):
    return sp.intersects_lines(fx.areas(spark, root), "area_id", fx.seg(spark, root), "comid", CELL)


_CE = f"ce AS {q.ring_edges('catchments', 'catchment_id')}"
_CEDGE = ("ce.x1", "ce.y1", "ce.x2", "ce.y2")


@query("q_poly_intersects", f"""
WITH {_AE}, {_CE},
hit AS (SELECT DISTINCT ae.area_id, ce.catchment_id FROM ae, ce WHERE {q.intersects(*_EDGE, *_CEDGE)}),
b_in_a AS (SELECT ae.area_id, c.catchment_id FROM ae, catchments c GROUP BY 1, 2, c.v
           HAVING sum({q.crossing('c.x', 'c.y', *_EDGE)}) % 2 = 1),
a_in_b AS (SELECT a.area_id, ce.catchment_id FROM areas a, ce GROUP BY 1, 2, a.v
           HAVING sum({q.crossing('a.x', 'a.y', *_CEDGE)}) % 2 = 1)
SELECT area_id, catchment_id FROM hit UNION SELECT area_id, catchment_id FROM b_in_a
UNION SELECT area_id, catchment_id FROM a_in_b""")
def q_poly_intersects(spark, root):
    return sp.intersects_polygons(fx.areas(spark, root), "area_id", fx.catchments(spark, root), "catchment_id", CELL)


# Independent of the engine's rule: the bound watersheds are convex and listed
# counter-clockwise, so an area covers a segment if both ends are on the inner
# side of all its edges.
@query("q_spatial_covers", f"""
WITH {_AE},
out AS (SELECT DISTINCT ae.area_id, s.comid FROM ae, seg s
        WHERE {q.orient('ae.x1', 'ae.y1', 'ae.x2', 'ae.y2', 's.x1', 's.y1')} < 0
           OR {q.orient('ae.x1', 'ae.y1', 'ae.x2', 'ae.y2', 's.x2', 's.y2')} < 0)
SELECT a.area_id, s.comid FROM (SELECT DISTINCT area_id FROM areas) a, seg s
EXCEPT SELECT area_id, comid FROM out""")
def q_spatial_covers(spark, root):
    return sp.covers_lines(fx.areas(spark, root), "area_id", fx.seg(spark, root), "comid", CELL)


@query("q_near_boundary", f"""
WITH {_AE}
SELECT DISTINCT ae.area_id, s.comid FROM ae, seg s WHERE {q.within(NEAR, *_EDGE, *_SEG)}""")
def q_near_boundary(spark, root):
    return sp.near_boundary(fx.areas(spark, root), "area_id", fx.seg(spark, root), "comid", NEAR, CELL)


def _square_rings(spark, root):
    """Ring vertices ``(grp, cell, v, x, y)`` of each group's distinct unit cells."""
    cells = fx.coverage(spark, root).select("grp", "cx", "cy").distinct()
    corners = F.array(*[F.struct(F.lit(i).alias("v"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                        for i, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])])
    v = cells.select("grp", (F.col("cy") * fx.COVERAGE_SIDE + F.col("cx")).alias("cell"), "cx", "cy",
                     F.explode(corners).alias("c"))
    return v.select("grp", "cell", F.col("c.v").alias("v"), (F.col("cx") + F.col("c.dx")).cast("double").alias("x"),
                    (F.col("cy") + F.col("c.dy")).cast("double").alias("y"))


@query("q_dissolve", """
WITH sq AS (SELECT DISTINCT grp, CAST(cx AS DOUBLE) AS x0, CAST(cy AS DOUBLE) AS y0 FROM coverage),
e AS (SELECT grp, x0 AS x1, y0 AS y1, x0 + 1 AS x2, y0 AS y2 FROM sq
      UNION ALL SELECT grp, x0 + 1, y0, x0 + 1, y0 + 1 FROM sq
      UNION ALL SELECT grp, x0, y0 + 1, x0 + 1, y0 + 1 FROM sq
      UNION ALL SELECT grp, x0, y0, x0, y0 + 1 FROM sq)
SELECT grp, x1, y1, x2, y2 FROM e GROUP BY ALL HAVING count(*) = 1""")
def q_dissolve(spark, root):
    return sp.dissolve(_square_rings(spark, root), "grp", "cell", CELL)


@query("q_dissolve_rings")
def q_dissolve_rings(spark, root):
    return rg.union_rings(_square_rings(spark, root), "grp", "cell", CELL)


# Independent of the rings: cells that share an edge make up a part; its area is
# their number, its outline their free edges.
@query("q_dissolve_parts", """
WITH RECURSIVE sq AS (SELECT DISTINCT grp, cx, cy FROM coverage),
near AS (SELECT a.grp, a.cx, a.cy, b.cx AS bx, b.cy AS by FROM sq a JOIN sq b
         ON a.grp = b.grp AND abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1),
walk AS (SELECT grp, cx, cy, cx AS sx, cy AS sy FROM sq
          UNION SELECT r.grp, n.bx, n.by, r.sx, r.sy FROM walk r JOIN near n ON r.grp = n.grp AND r.cx = n.cx AND r.cy = n.cy),
part AS (SELECT grp, cx, cy, min((sx, sy)) AS p FROM walk GROUP BY 1, 2, 3),
free AS (SELECT s.grp, s.cx, s.cy, 4 - count(n.bx) AS k FROM sq s LEFT JOIN near n ON s.grp = n.grp AND s.cx = n.cx AND s.cy = n.cy GROUP BY 1, 2, 3)
SELECT p.grp, CAST(min(p.cx) AS DOUBLE) AS x0, CAST(min(p.cy) FILTER (p.cx = p.p[1]) AS DOUBLE) AS y0,
       CAST(count(*) AS DOUBLE) AS area, CAST(sum(f.k) AS DOUBLE) AS length
FROM part p JOIN free f ON p.grp = f.grp AND p.cx = f.cx AND p.cy = f.cy GROUP BY p.grp, p.p""")
def q_dissolve_parts(spark, root):
    rings = rg.union_rings(_square_rings(spark, root), "grp", "cell", CELL)
    return rounded(rg.part_measures(rings, "grp").select("grp", "x0", "y0", "area", "length"))


# The oracle rests on the convex watersheds: covered if both ends are inside.
@query("q_outflow_flags", f"""
WITH {_AE},
out AS (SELECT DISTINCT ae.area_id, s.comid FROM ae, seg s
        WHERE {q.orient('ae.x1', 'ae.y1', 'ae.x2', 'ae.y2', 's.x1', 's.y1')} < 0
           OR {q.orient('ae.x1', 'ae.y1', 'ae.x2', 'ae.y2', 's.x2', 's.y2')} < 0)
SELECT ae.area_id, s.comid, bool_or({q.within(NEAR, *_EDGE, *_SEG)}) AS boundary,
       bool_or({q.dist2('s.x2', 's.y2', *_EDGE)} <= {NEAR * NEAR!r}) AS outflow
FROM ae, seg s WHERE NOT EXISTS (SELECT 1 FROM out o WHERE o.area_id = ae.area_id AND o.comid = s.comid) GROUP BY 1, 2""")
def q_outflow_flags(spark, root):
    s = fx.seg(spark, root)
    sinks = s.select("comid", F.col("x2").alias("px"), F.col("y2").alias("py"))
    return sp.outline_flags(sp.kept_edges(fx.areas(spark, root), "area_id"), "area_id", s, "comid", sinks, NEAR, CELL)


# Convex watersheds again: a segment enters and leaves once, at the last entry
# and the first exit over the sides of the outline.
@query("q_extract_geometry", f"""
WITH {_AE},
side AS (SELECT ae.area_id, s.comid, s.x1, s.y1, s.x2, s.y2,
                {q.orient('ae.x1', 'ae.y1', 'ae.x2', 'ae.y2', 's.x1', 's.y1')} AS a,
                {q.orient('ae.x1', 'ae.y1', 'ae.x2', 'ae.y2', 's.x2', 's.y2')} AS b FROM ae, seg s),
t AS (SELECT area_id, comid, x1, y1, x2, y2, max(CASE WHEN a < 0 AND b > a THEN a / (a - b) ELSE 0 END) AS lo,
             min(CASE WHEN b < 0 AND a > b THEN a / (a - b) ELSE 1 END) AS hi, bool_or(a < 0 AND b < 0) AS off
      FROM side GROUP BY ALL)
SELECT area_id, true AS is_boundary, CAST(0 AS BIGINT) AS comid, CAST(v AS INTEGER) AS v, round(x, 6) AS x, round(y, 6) AS y FROM areas
UNION ALL SELECT area_id, false, comid, 0, round(x1 + lo * (x2 - x1), 6), round(y1 + lo * (y2 - y1), 6) FROM t WHERE lo < hi AND NOT off
UNION ALL SELECT area_id, false, comid, 1, round(x1 + hi * (x2 - x1), 6), round(y1 + hi * (y2 - y1), 6) FROM t WHERE lo < hi AND NOT off""")
def q_extract_geometry(spark, root):
    areas = fx.areas(spark, root)
    cut = sp.clip_lines(sp.kept_edges(areas, "area_id"), "area_id", fx.seg(spark, root), "comid", CELL)
    ends = cut.select("area_id", F.lit(False).alias("is_boundary"), "comid", F.expr("stack(2, 0, x1, y1, 1, x2, y2) as (v, x, y)"))
    outline = areas.select("area_id", F.lit(True).alias("is_boundary"), F.lit(0).cast("long").alias("comid"), F.col("v").cast("int").alias("v"), "x", "y")
    return rounded(outline.unionByName(ends))


@query("q_bounds", """
SELECT catchment_id, round(min(x), 6) AS xmin, round(min(y), 6) AS ymin, round(max(x), 6) AS xmax,
       round(max(y), 6) AS ymax FROM catchments GROUP BY 1""")
def q_bounds(spark, root):
    return rounded(sp.bounds(fx.catchments(spark, root), "catchment_id"))


@query("q_bbox", f"""
SELECT time, y, x, round(zwattablrt, 6) AS zwattablrt FROM grid
WHERE x BETWEEN {BBOX_X[0]} AND {BBOX_X[1]} AND y BETWEEN {BBOX_Y[0]} AND {BBOX_Y[1]}
  AND time >= TIMESTAMP '{BBOX_DAY}' AND time < TIMESTAMP '{BBOX_DAY}' + INTERVAL 1 DAY""")
def q_bbox(spark, root):
    g = fx.grid(spark, root)
    return rounded(g.where(F.col("x").between(*BBOX_X) & F.col("y").between(*BBOX_Y)
                           & partial_label("time", BBOX_DAY)))


@query("q_force_2d", """
SELECT comid, CAST(0 AS INTEGER) AS v, round(x1, 6) AS x, round(y1, 6) AS y FROM seg
UNION ALL SELECT comid, CAST(1 AS INTEGER) AS v, round(x2, 6) AS x, round(y2, 6) AS y FROM seg""")
def q_force_2d(spark, root):
    s = fx.seg(spark, root)
    z = F.col("comid").cast("double")
    line3d = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), z.alias("z")),
                     F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), z.alias("z")))
    flat = s.select("comid", geo.force_2d(line3d).alias("pts"))
    return rounded(flat.select("comid", F.posexplode("pts").alias("v", "p"))
                       .select("comid", "v", F.col("p.x").alias("x"), F.col("p.y").alias("y")))


def _albers_sql(lon, lat):
    k = geo.albers_constants(**geo.ALBERS_5070)
    s = f"sin(radians({lat}))"
    qq = (f"({1 - k['e2']!r} * ({s} / (1.0 - {k['e2']!r} * {s} * {s}) - {1 / (2 * k['e'])!r} * "
          f"ln((1.0 - {k['e']!r} * {s}) / (1.0 + {k['e']!r} * {s}))))")
    rho = f"({k['a']!r} * sqrt({k['c']!r} - {k['n']!r} * {qq}) / {k['n']!r})"
    th = f"({k['n']!r} * (radians({lon}) - {k['lon_0']!r}))"
    return f"{rho} * sin({th})", f"{k['rho0']!r} - {rho} * cos({th})"


def _lcc_sql(lon, lat):
    k = geo.lcc_constants(**geo.LCC_GRID)
    t = f"tan({math.pi / 4!r} + radians({lat}) / 2)"
    rho = f"({k['r'] * k['f']!r} / pow({t}, {k['n']!r}))"
    th = f"({k['n']!r} * (radians({lon}) - {k['lon_0']!r}))"
    return f"{rho} * sin({th})", f"{k['rho0']!r} - {rho} * cos({th})"


_LON = f"({LON_0} + x1 * {LON_SCALE})"
_LAT = f"({LAT_0} + y1 * {LAT_SCALE})"
_AX, _AY = _albers_sql(_LON, _LAT)
_LX, _LY = _lcc_sql(_LON, _LAT)


@query("q_reproject", f"""
SELECT comid, round({_LON}, 6) AS lon, round({_LAT}, 6) AS lat,
       round({_AX}, 3) AS x_albers, round({_AY}, 3) AS y_albers, round({_LX}, 3) AS x_lcc, round({_LY}, 3) AS y_lcc
FROM seg""")
def q_reproject(spark, root):
    s = fx.seg(spark, root)
    lon = F.lit(LON_0) + F.col("x1") * LON_SCALE
    lat = F.lit(LAT_0) + F.col("y1") * LAT_SCALE
    ax, ay = geo.albers(lon, lat)
    lx, ly = geo.lcc(lon, lat)
    return s.select("comid", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"),
                    F.round(ax, 3).alias("x_albers"), F.round(ay, 3).alias("y_albers"),
                    F.round(lx, 3).alias("x_lcc"), F.round(ly, 3).alias("y_lcc"))


@query("q_reproject_back", f"""
SELECT comid, round({_LON}, 6) AS lon_albers, round({_LAT}, 6) AS lat_albers,
       round({_LON}, 6) AS lon_lcc, round({_LAT}, 6) AS lat_lcc FROM seg""")
def q_reproject_back(spark, root):
    """Points carried to both map grids and back to degrees."""
    lon = F.lit(LON_0) + F.col("x1") * LON_SCALE
    lat = F.lit(LAT_0) + F.col("y1") * LAT_SCALE
    grids = {"albers": (geo.albers, geo.albers_inverse), "lcc": (geo.lcc, geo.lcc_inverse)}
    s = fx.seg(spark, root)
    for name, (forward, _) in grids.items():
        x, y = forward(lon, lat)
        s = s.withColumns({f"x_{name}": x, f"y_{name}": y})
    back = {name: inverse(F.col(f"x_{name}"), F.col(f"y_{name}")) for name, (_, inverse) in grids.items()}
    return rounded(s.select("comid", *[c.alias(f"{axis}_{name}") for name, cs in back.items() for axis, c in zip(("lon", "lat"), cs)]))


@query("q_box_corners", """
WITH b AS (SELECT catchment_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM catchments GROUP BY 1)
SELECT catchment_id, CAST(v AS INTEGER) AS v, round(CASE WHEN v IN (1, 2) THEN x1 ELSE x0 END, 6) AS x,
       round(CASE WHEN v IN (2, 3) THEN y1 ELSE y0 END, 6) AS y
FROM b, range(0, 4) r(v)""")
def q_box_corners(spark, root):
    return rounded(sp.box_corners(sp.bounds(fx.catchments(spark, root), "catchment_id"), "catchment_id"))
