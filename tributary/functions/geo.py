"""Coordinate functions: drop Z, and closed-form map projections as column math.

Projection constants depend only on the projection parameters; they are
computed once here and enter the plan as literals, so the per-row work is a
few built-in trigonometric expressions inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# EPSG:5070 (NAD83 / Conus Albers) on the GRS80 ellipsoid.
ALBERS_5070 = dict(a=6378137.0, inv_f=298.257222101, lat_1=29.5, lat_2=45.5, lat_0=23.0, lon_0=-96.0)
# The Lambert conformal conic grid of the channel model, on a sphere.
LCC_GRID = dict(r=6370000.0, lat_1=30.0, lat_2=60.0, lat_0=40.0, lon_0=-97.0)


def force_2d(points: Column) -> Column:
    """Array of ``struct(x, y, z)`` to array of ``struct(x, y)``."""
    return F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def albers_constants(a, inv_f, lat_1, lat_2, lat_0, lon_0) -> dict[str, float]:
    f = 1.0 / inv_f
    e2 = 2 * f - f * f
    e = math.sqrt(e2)

    def q(phi):
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - (1 / (2 * e)) * math.log((1 - e * s) / (1 + e * s)))

    def m(phi):
        s = math.sin(phi)
        return math.cos(phi) / math.sqrt(1 - e2 * s * s)

    p1, p2, p0 = (math.radians(v) for v in (lat_1, lat_2, lat_0))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    rho0 = a * math.sqrt(c - n * q(p0)) / n
    return dict(a=a, e=e, e2=e2, n=n, c=c, rho0=rho0, lon_0=math.radians(lon_0))


def lcc_constants(r, lat_1, lat_2, lat_0, lon_0) -> dict[str, float]:
    p1, p2, p0 = (math.radians(v) for v in (lat_1, lat_2, lat_0))
    t = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.log(math.cos(p1) / math.cos(p2)) / math.log(t(p2) / t(p1))
    big_f = math.cos(p1) * t(p1) ** n / n
    rho0 = r * big_f / t(p0) ** n
    return dict(r=r, n=n, f=big_f, rho0=rho0, lon_0=math.radians(lon_0))


def albers(lon: Column, lat: Column, params: dict | None = None) -> tuple[Column, Column]:
    """Ellipsoidal Albers equal-area conic, degrees in, metres out (F16)."""
    k = albers_constants(**(params or ALBERS_5070))
    s = F.sin(F.radians(lat))
    q = F.lit(1 - k["e2"]) * (s / (F.lit(1.0) - F.lit(k["e2"]) * s * s)
                               - F.lit(1 / (2 * k["e"])) * F.log((F.lit(1.0) - F.lit(k["e"]) * s)
                                                                 / (F.lit(1.0) + F.lit(k["e"]) * s)))
    rho = F.lit(k["a"]) * F.sqrt(F.lit(k["c"]) - F.lit(k["n"]) * q) / F.lit(k["n"])
    theta = F.lit(k["n"]) * (F.radians(lon) - F.lit(k["lon_0"]))
    return rho * F.sin(theta), F.lit(k["rho0"]) - rho * F.cos(theta)


def lcc(lon: Column, lat: Column, params: dict | None = None) -> tuple[Column, Column]:
    """Spherical Lambert conformal conic, degrees in, metres out (F16)."""
    k = lcc_constants(**(params or LCC_GRID))
    t = F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)
    rho = F.lit(k["r"] * k["f"]) / F.pow(t, F.lit(k["n"]))
    theta = F.lit(k["n"]) * (F.radians(lon) - F.lit(k["lon_0"]))
    return rho * F.sin(theta), F.lit(k["rho0"]) - rho * F.cos(theta)


def albers_inverse(x: Column, y: Column, params: dict | None = None) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of :func:`albers` coordinates (F16).

    The latitude is a fixed point; six steps reach the precision of doubles at
    every latitude of a northern cone.
    """
    k = albers_constants(**(params or ALBERS_5070))
    e, e2 = F.lit(k["e"]), F.lit(k["e2"])
    up = F.lit(k["rho0"]) - y
    q = (F.lit(k["c"]) - (x * x + up * up) * F.lit((k["n"] / k["a"]) ** 2)) / F.lit(k["n"])

    def step(phi: Column, s: Column) -> Column:
        w = F.lit(1.0) - e2 * s * s
        rest = q / F.lit(1 - k["e2"]) - s / w + F.log((F.lit(1.0) - e * s) / (F.lit(1.0) + e * s)) * F.lit(1 / (2 * k["e"]))
        return phi + w * w / (F.cos(phi) * 2) * rest

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.asin(q / 2), lambda p, _: step(p, F.sin(p)))
    return F.degrees(F.atan2(x, up) / F.lit(k["n"]) + F.lit(k["lon_0"])), F.degrees(phi)


def lcc_inverse(x: Column, y: Column, params: dict | None = None) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of :func:`lcc` coordinates, in closed form (F16)."""
    k = lcc_constants(**(params or LCC_GRID))
    up = F.lit(k["rho0"]) - y
    rho = F.sqrt(x * x + up * up)
    phi = F.atan(F.pow(F.lit(k["r"] * k["f"]) / rho, F.lit(1 / k["n"]))) * 2 - F.lit(math.pi / 2)
    return F.degrees(F.atan2(x, up) / F.lit(k["n"]) + F.lit(k["lon_0"])), F.degrees(phi)
