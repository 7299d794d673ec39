"""Hydrology tables bound to the driver's test tables.

The bindings are fixed by the project's fixture plan: each hydrology input
(reach cube, forecast cube, gauges, watersheds, hydrofabric relations, file
catalogs, line segments, timing results) is a projection or aggregate of a
driver table, so every query runs offline, grows with the scale factor and
has a DuckDB counterpart in :mod:`tributary.plans.oracle_views`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import scan


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def flow(spark: SparkSession, root: str) -> DataFrame:
    """Reach cube ``(feature_id, time, streamflow)``, daily."""
    li = scan(spark, root, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("feature_id"), F.col("l_shipdate").alias("time"))
              .agg(F.avg("l_quantity").alias("streamflow")))


def forecast_hourly(spark: SparkSession, root: str) -> DataFrame:
    """Hourly forecast cube: an event is a forecast made in its hour, valid 1
    to 18 hours later."""
    ev = scan(spark, root, "events")
    made = _ntz(F.date_trunc("hour", "ts"))
    return (ev.groupBy(F.col("user_id").alias("feature_id"), made.alias("reference_time"),
                       (made + F.make_dt_interval(F.lit(0), (F.col("event_id") % 18 + 1).cast("int"))).alias("time"))
              .agg(F.avg("value").alias("streamflow")))


def forecast(spark: SparkSession, root: str) -> DataFrame:
    """Forecast cube ``(feature_id, reference_time, time, streamflow)``; monthly
    axes.  A forecast is valid after its reference time, by definition."""
    li = scan(spark, root, "lineitem")
    od = scan(spark, root, "orders")
    j = li.join(od, li.l_orderkey == od.o_orderkey).where(F.col("l_shipdate") > F.col("o_orderdate"))
    return (j.groupBy(F.col("l_suppkey").alias("feature_id"),
                      _ntz(F.date_trunc("month", "o_orderdate")).alias("reference_time"),
                      _ntz(F.date_trunc("month", "l_shipdate")).alias("time"))
             .agg(F.avg("l_quantity").alias("streamflow")))


def grid(spark: SparkSession, root: str) -> DataFrame:
    """Grid cube ``(time, y, x, zwattablrt)``."""
    ev = scan(spark, root, "events")
    return (ev.groupBy(_ntz(F.date_trunc("day", "ts")).alias("time"),
                       (F.col("user_id") % 10).cast("double").alias("y"),
                       F.col("user_id").cast("double").alias("x"))
              .agg(F.avg("value").alias("zwattablrt")))


# The event types that stand for forecasts; all others are observations.
FORECAST_EVENTS = ["purchase", "signup"]


def gauge(spark: SparkSession, root: str) -> DataFrame:
    """Gauge observations ``(site, value_date, value)``; some values negative.
    Every event is an observation or a forecast (:func:`gauge_forecast`)."""
    ev = scan(spark, root, "events").where(~F.col("event_type").isin(FORECAST_EVENTS) | F.col("event_type").isNull())
    return (ev.groupBy(F.col("user_id").alias("site"),
                       _ntz(F.date_trunc("day", "ts")).alias("value_date"))
              .agg((F.avg("value") - 20).alias("value")))


def gauge_forecast(spark: SparkSession, root: str) -> DataFrame:
    """Forecasts at gauges ``(site, nwm_feature_id, value_date, value)``."""
    ev = scan(spark, root, "events").where(F.col("event_type").isin(FORECAST_EVENTS))
    return (ev.groupBy(F.col("user_id").alias("site"),
                       (F.col("user_id") + 1000).alias("nwm_feature_id"),
                       _ntz(F.date_trunc("day", "ts")).alias("value_date"))
              .agg(F.avg("value").alias("value")))


def huc(spark: SparkSession, root: str) -> DataFrame:
    """Watershed codes: 4-digit code, its 2-digit parent, join key."""
    n = scan(spark, root, "nation")
    return n.select(F.concat(_pad(n.n_regionkey, 2), _pad(n.n_nationkey, 2)).alias("huc4"),
                    _pad(n.n_regionkey, 2).alias("huc2"),
                    n.n_nationkey.alias("huc_key"))


def reach(spark: SparkSession, root: str) -> DataFrame:
    """Reach ids with their watershed; only some are in ``flow``."""
    c = scan(spark, root, "customer")
    return c.select(c.c_custkey.alias("comid"), c.c_nationkey.alias("huc_key"))


def divides(spark: SparkSession, root: str) -> DataFrame:
    p = scan(spark, root, "part")
    return p.select(p.p_partkey.alias("toid"), p.p_size.alias("aoi"))


def flowpaths(spark: SparkSession, root: str) -> DataFrame:
    li = scan(spark, root, "lineitem")
    return li.select(li.l_orderkey.alias("id"), li.l_partkey.alias("toid"),
                     li.l_linenumber.alias("ord")).distinct()


def nexus(spark: SparkSession, root: str) -> DataFrame:
    s = scan(spark, root, "supplier")
    return s.select(s.s_suppkey.alias("id"), (s.s_acctbal < 0).alias("outflow"))


def crosswalk(spark: SparkSession, root: str) -> DataFrame:
    o = scan(spark, root, "orders")
    return o.select(o.o_orderkey.alias("id"), o.o_custkey.alias("comid"), (o.o_orderkey % 4).cast("int").alias("part"))


def _catalog(df: DataFrame, day: str, key: str, prefix: str, suffix: str) -> DataFrame:
    path = F.concat(F.lit(prefix + "nwm."), F.date_format(day, "yyyyMMdd"),
                    F.lit("/short_range/nwm.t"), _pad(F.col(key) % 24, 2),
                    F.lit("z.short_range.channel_rt.f"), _pad(1 + F.col(key) % 18, 3),
                    F.lit(suffix))
    return df.select(path.alias("path")).distinct()


def catalog_src(spark: SparkSession, root: str) -> DataFrame:
    """Source forecast files (object keys): one per order date and key."""
    return _catalog(scan(spark, root, "orders"), "o_orderdate", "o_orderkey", "", ".conus.nc")


def catalog_dst(spark: SparkSession, root: str) -> DataFrame:
    """Index files: one per ship date and key, so the catalogs differ by themselves."""
    return _catalog(scan(spark, root, "lineitem"), "l_shipdate", "l_orderkey", "kerchunk/", ".conus.json")


def seg(spark: SparkSession, root: str) -> DataFrame:
    """Line segments ``(comid, x1, y1, x2, y2)``."""
    e = scan(spark, root, "embeddings")
    xy = [(F.col("embedding")[i].cast("double") * 10).alias(n)
          for i, n in enumerate(["x1", "y1", "x2", "y2"])]
    return e.select(F.col("vec_id").alias("comid"), *xy)


# Fixed value: cells per row of the coverage lattice; it has as many rows as the keys fill.
COVERAGE_SIDE = 40


def coverage(spark: SparkSession, root: str) -> DataFrame:
    """Unit cells ``(toid, grp, cx, cy)``, one per customer, grouped by nation;
    the union of a group's cells is what dissolve outlines."""
    c = scan(spark, root, "customer")
    return c.select(c.c_custkey.alias("toid"), c.c_nationkey.alias("grp"),
                    (c.c_custkey % COVERAGE_SIDE).cast("int").alias("cx"),
                    F.floor(c.c_custkey / COVERAGE_SIDE).cast("int").alias("cy"))


def results(spark: SparkSession, root: str) -> DataFrame:
    """Timing rows ``(query, nb_days, source, time)``."""
    li = scan(spark, root, "lineitem")
    return li.select(li.l_returnflag.alias("query"), li.l_linenumber.alias("nb_days"),
                     F.when(li.l_linestatus == "O", "base").otherwise("rechunked").alias("source"),
                     (li.l_extendedprice / 1000).alias("time"))


# The corner offsets of the watershed quadrilaterals, listed
# counter-clockwise, and their centre grid (a 5 x 5 lattice, 2 units apart,
# one cell per nation). Each ring is convex by construction.
AREA_CORNERS = [(-0.9, -0.6), (0.7, -0.9), (0.9, 0.7), (-0.6, 0.9)]
AREA_ORIGIN = -4.0
AREA_STEP = 2.0


def areas(spark: SparkSession, root: str) -> DataFrame:
    """Watershed polygons as ring vertices ``(area_id, v, x, y)``; one ring each."""
    n = scan(spark, root, "nation")
    cx = F.lit(AREA_ORIGIN) + F.lit(AREA_STEP) * (n.n_nationkey % 5)
    cy = F.lit(AREA_ORIGIN) + F.lit(AREA_STEP) * F.floor(n.n_nationkey / 5)
    corners = F.array(*[F.struct(F.lit(i).alias("v"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                        for i, (dx, dy) in enumerate(AREA_CORNERS)])
    pts = n.select(n.n_nationkey.alias("area_id"), cx.alias("cx"), cy.alias("cy"),
                   F.explode(corners).alias("c"))
    return pts.select("area_id", F.col("c.v").alias("v"),
                      (F.col("cx") + F.col("c.dx")).alias("x"),
                      (F.col("cy") + F.col("c.dy")).alias("y"))


# Catchment squares of the second polygon layer, one per part:
# lower-left corner on a 25 x 25 lattice from (-4.6, -4.6) with step 0.37,
# side 0.2 plus a hundredth of the part size.
CATCHMENT_ORIGIN = -4.6
CATCHMENT_STEP = 0.37
CATCHMENT_LATTICE = 25
CATCHMENT_SIDE_BASE = 0.2


def catchments(spark: SparkSession, root: str) -> DataFrame:
    """Second polygon layer ``(catchment_id, v, x, y)``: one square per part."""
    p = scan(spark, root, "part")
    x0 = F.lit(CATCHMENT_ORIGIN) + F.lit(CATCHMENT_STEP) * (p.p_partkey % CATCHMENT_LATTICE)
    y0 = F.lit(CATCHMENT_ORIGIN) + F.lit(CATCHMENT_STEP) * (F.floor(p.p_partkey / CATCHMENT_LATTICE)
                                                            % CATCHMENT_LATTICE)
    side = F.lit(CATCHMENT_SIDE_BASE) + p.p_size / F.lit(100.0)
    sq = p.select(p.p_partkey.alias("catchment_id"), x0.alias("x0"), y0.alias("y0"), side.alias("s"))
    corners = F.array(
        F.struct(F.lit(0).alias("v"), F.col("x0").alias("x"), F.col("y0").alias("y")),
        F.struct(F.lit(1).alias("v"), (F.col("x0") + F.col("s")).alias("x"), F.col("y0").alias("y")),
        F.struct(F.lit(2).alias("v"), (F.col("x0") + F.col("s")).alias("x"), (F.col("y0") + F.col("s")).alias("y")),
        F.struct(F.lit(3).alias("v"), F.col("x0").alias("x"), (F.col("y0") + F.col("s")).alias("y")))
    return sq.select("catchment_id", F.explode(corners).alias("c")).select("catchment_id", "c.v", "c.x", "c.y")


FIXTURES = {
    "flow": flow, "forecast": forecast, "forecast_hourly": forecast_hourly, "grid": grid,
    "gauge": gauge, "gauge_forecast": gauge_forecast, "huc": huc, "reach": reach,
    "divides": divides, "flowpaths": flowpaths, "nexus": nexus, "crosswalk": crosswalk,
    "catalog_src": catalog_src, "catalog_dst": catalog_dst, "seg": seg,
    "coverage": coverage, "results": results, "areas": areas, "catchments": catchments,
}


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return FIXTURES[name](spark, root)
