"""DuckDB text of the exact spatial predicates, for brute-force oracles.

Same arithmetic, in the same order, as :mod:`tributary.operators.spatial`,
so both engines compute bit-identical doubles.
"""

from __future__ import annotations


def orient(ax, ay, bx, by, cx, cy) -> str:
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def on_box(ax, ay, bx, by, cx, cy) -> str:
    return (f"({cx} >= least({ax}, {bx}) AND {cx} <= greatest({ax}, {bx}) AND "
            f"{cy} >= least({ay}, {by}) AND {cy} <= greatest({ay}, {by}))")


def _orients(p1x, p1y, p2x, p2y, q1x, q1y, q2x, q2y):
    return (orient(p1x, p1y, p2x, p2y, q1x, q1y), orient(p1x, p1y, p2x, p2y, q2x, q2y),
            orient(q1x, q1y, q2x, q2y, p1x, p1y), orient(q1x, q1y, q2x, q2y, p2x, p2y))


def proper(*c) -> str:
    o1, o2, o3, o4 = _orients(*c)
    return (f"((({o1} > 0 AND {o2} < 0) OR ({o1} < 0 AND {o2} > 0)) AND "
            f"(({o3} > 0 AND {o4} < 0) OR ({o3} < 0 AND {o4} > 0)))")


def intersects(p1x, p1y, p2x, p2y, q1x, q1y, q2x, q2y) -> str:
    o1, o2, o3, o4 = _orients(p1x, p1y, p2x, p2y, q1x, q1y, q2x, q2y)
    touch = (f"(({o1} = 0 AND {on_box(p1x, p1y, p2x, p2y, q1x, q1y)}) OR "
             f"({o2} = 0 AND {on_box(p1x, p1y, p2x, p2y, q2x, q2y)}) OR "
             f"({o3} = 0 AND {on_box(q1x, q1y, q2x, q2y, p1x, p1y)}) OR "
             f"({o4} = 0 AND {on_box(q1x, q1y, q2x, q2y, p2x, p2y)}))")
    return f"({proper(p1x, p1y, p2x, p2y, q1x, q1y, q2x, q2y)} OR {touch})"


def crossing(px, py, x1, y1, x2, y2) -> str:
    """1 when the ray from p to +x crosses edge (x1,y1)-(x2,y2), else 0."""
    return (f"(CASE WHEN ({y1} > {py}) <> ({y2} > {py}) THEN "
            f"(CASE WHEN {px} < {x1} + ({py} - {y1}) * ({x2} - {x1}) / ({y2} - {y1}) THEN 1 ELSE 0 END) ELSE 0 END)")


def on_segment(px, py, ax, ay, bx, by) -> str:
    return f"({orient(ax, ay, bx, by, px, py)} = 0 AND {on_box(ax, ay, bx, by, px, py)})"


def dist2(px, py, ax, ay, bx, by) -> str:
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    t = (f"(CASE WHEN {len2} > 0 THEN greatest(0.0, least(1.0, (({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / {len2})) "
         f"ELSE 0.0 END)")
    qx, qy = f"({ax} + {t} * {dx})", f"({ay} + {t} * {dy})"
    return f"(({px} - {qx}) * ({px} - {qx}) + ({py} - {qy}) * ({py} - {qy}))"


def within(d, p1x, p1y, p2x, p2y, q1x, q1y, q2x, q2y) -> str:
    near = (f"least({dist2(p1x, p1y, q1x, q1y, q2x, q2y)}, {dist2(p2x, p2y, q1x, q1y, q2x, q2y)}, "
            f"{dist2(q1x, q1y, p1x, p1y, p2x, p2y)}, {dist2(q2x, q2y, p1x, p1y, p2x, p2y)}) <= {float(d) * float(d)!r}")
    return f"({intersects(p1x, p1y, p2x, p2y, q1x, q1y, q2x, q2y)} OR {near})"


def ring_edges(table: str, id_col: str) -> str:
    return (f"(SELECT a.{id_col}, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {table} a "
            f"JOIN (SELECT {id_col}, count(*) AS n FROM {table} GROUP BY 1) c ON a.{id_col} = c.{id_col} "
            f"JOIN {table} b ON a.{id_col} = b.{id_col} AND b.v = (a.v + 1) % c.n)")
