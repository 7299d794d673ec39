"""Named queries over the reach cube: selections, id resolution, climatology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import partial_label, range_closed, range_open, ts
from ..operators import climatology as clim
from ..operators.ids import id_counts, subset_ids
from ..sources import fixtures as fx
from ..sources.tables import scan
from .common import (BASE_FLOW_SINCE, INSTANT, MONTH_LABEL, POINT_FEATURE, RANGE_START,
                     RANGE_STOP, SQL_AREA_IDS, SQL_CLOSED, SQL_OPEN, rounded, study_available,
                     study_ids)
from .registry import query


def closed_subset(spark, root):
    """Study-area reaches in the closed date range: the input of the cube queries.

    A semi join on the area's ids selects exactly the ids the cube holds, so
    the intersection step of the reference (J1) is not a separate pass here.
    """
    flow = fx.flow(spark, root).where(range_closed("time", RANGE_START, RANGE_STOP))
    return subset_ids(flow, study_ids(spark, root))


def open_subset(spark, root):
    """Study-area reaches in the open range: the input of the table queries."""
    flow = fx.flow(spark, root)
    return subset_ids(flow, study_ids(spark, root)).where(range_open("time", RANGE_START, RANGE_STOP))


_SQL_CLOSED_SUB = f"SELECT * FROM flow WHERE feature_id IN {SQL_AREA_IDS} AND {SQL_CLOSED}"
_SQL_OPEN_SUB = f"SELECT * FROM flow WHERE feature_id IN {SQL_AREA_IDS} AND {SQL_OPEN}"


@query("q_mean_features_mean_day", f"""
WITH sub AS ({_SQL_CLOSED_SUB}),
pt AS (SELECT time, avg(streamflow) AS streamflow FROM sub GROUP BY time)
SELECT CAST(dayofyear(time) AS INTEGER) AS dayofyear, round(avg(streamflow), 6) AS streamflow
FROM pt GROUP BY 1""")
def q_mean_features_mean_day(spark, root):
    return rounded(clim.mean_features_mean_day(closed_subset(spark, root)))


@query("q_mean_day", f"""
SELECT feature_id, CAST(dayofyear(time) AS INTEGER) AS dayofyear, round(avg(streamflow), 6) AS streamflow
FROM ({_SQL_CLOSED_SUB}) GROUP BY 1, 2""")
def q_mean_day(spark, root):
    return rounded(clim.mean_day(closed_subset(spark, root)))


@query("q_mean_week", f"""
SELECT feature_id, CAST(weekofyear(time) AS INTEGER) AS week, round(avg(streamflow), 6) AS streamflow
FROM ({_SQL_CLOSED_SUB}) GROUP BY 1, 2""")
def q_mean_week(spark, root):
    return rounded(clim.mean_week(closed_subset(spark, root)))


@query("q_pooled_day", f"""
SELECT CAST(dayofyear(time) AS INTEGER) AS dayofyear, round(avg(streamflow), 6) AS streamflow
FROM ({_SQL_OPEN_SUB}) GROUP BY 1""")
def q_pooled_day(spark, root):
    return rounded(clim.pooled_day(open_subset(spark, root)))


@query("q_pooled_week", f"""
SELECT CAST(weekofyear(time) AS INTEGER) AS week, round(avg(streamflow), 6) AS streamflow
FROM ({_SQL_OPEN_SUB}) GROUP BY 1""")
def q_pooled_week(spark, root):
    return rounded(clim.pooled_week(open_subset(spark, root)))


@query("q_feature_day_open", f"""
SELECT feature_id, CAST(dayofyear(time) AS INTEGER) AS dayofyear, round(avg(streamflow), 6) AS streamflow
FROM ({_SQL_OPEN_SUB}) GROUP BY 1, 2""")
def q_feature_day_open(spark, root):
    return rounded(clim.mean_day(open_subset(spark, root)))


@query("q_base_flow", f"""
SELECT feature_id, CAST(weekofyear(time) AS INTEGER) AS week, round(avg(streamflow), 6) AS mean,
       round(stddev_pop(streamflow), 6) AS std
FROM flow WHERE time >= TIMESTAMP '{BASE_FLOW_SINCE}' GROUP BY 1, 2""")
def q_base_flow(spark, root):
    return rounded(clim.base_flow(fx.flow(spark, root), BASE_FLOW_SINCE))


@query("q_global_mean", "SELECT round(avg(streamflow), 6) AS streamflow FROM flow")
def q_global_mean(spark, root):
    return rounded(clim.global_mean(fx.flow(spark, root)))


@query("q_avail_ids", f"""
SELECT DISTINCT feature_id AS comid FROM flow WHERE feature_id IN {SQL_AREA_IDS}""")
def q_avail_ids(spark, root):
    return study_available(spark, root, fx.flow(spark, root))


@query("q_id_counts", f"""
SELECT (SELECT count(DISTINCT comid) FROM {SQL_AREA_IDS}) AS nb_area_ids,
       (SELECT count(DISTINCT feature_id) FROM flow WHERE feature_id IN {SQL_AREA_IDS}) AS nb_available_ids""")
def q_id_counts(spark, root):
    flow = fx.flow(spark, root)
    return id_counts(study_ids(spark, root), study_available(spark, root, flow))


@query("q_subset_ids", f"""
SELECT feature_id, time, round(streamflow, 6) AS streamflow FROM flow WHERE feature_id IN {SQL_AREA_IDS}""")
def q_subset_ids(spark, root):
    return rounded(subset_ids(fx.flow(spark, root), study_ids(spark, root)))


@query("q_range_closed", f"""
SELECT feature_id, time, round(streamflow, 6) AS streamflow FROM flow WHERE {SQL_CLOSED}""")
def q_range_closed(spark, root):
    return rounded(fx.flow(spark, root).where(range_closed("time", RANGE_START, RANGE_STOP)))


@query("q_range_open", f"""{_SQL_OPEN_SUB.replace('SELECT *', 'SELECT feature_id, time, round(streamflow, 6) AS streamflow')}""")
def q_range_open(spark, root):
    return rounded(open_subset(spark, root))


@query("q_instant", f"""
SELECT feature_id, time, round(streamflow, 6) AS streamflow FROM flow WHERE time = TIMESTAMP '{INSTANT}'""")
def q_instant(spark, root):
    return rounded(fx.flow(spark, root).where(F.col("time") == ts(INSTANT)))


@query("q_partial_label", f"""
SELECT feature_id, time, round(streamflow, 6) AS streamflow FROM flow
WHERE time >= TIMESTAMP '{MONTH_LABEL}-01' AND time < TIMESTAMP '{MONTH_LABEL}-01' + INTERVAL 1 MONTH""")
def q_partial_label(spark, root):
    return rounded(fx.flow(spark, root).where(partial_label("time", MONTH_LABEL)))


@query("q_point_lookup", f"""
SELECT feature_id, time, round(streamflow, 6) AS streamflow FROM flow WHERE feature_id = {POINT_FEATURE}""")
def q_point_lookup(spark, root):
    return rounded(fx.flow(spark, root).where(F.col("feature_id") == POINT_FEATURE))


@query("q_scan_project", """
SELECT l_shipdate AS time, l_suppkey AS feature_id, l_quantity AS streamflow FROM lineitem""")
def q_scan_project(spark, root):
    li = scan(spark, root, "lineitem")
    return li.select(li.l_shipdate.alias("time"), li.l_suppkey.alias("feature_id"),
                     li.l_quantity.alias("streamflow"))


# The multi-variable reach table read from lineitem, and the
# variables dropped from it.
_VARS = {"l_suppkey": "feature_id", "l_shipdate": "time", "l_quantity": "streamflow",
         "l_extendedprice": "velocity", "l_discount": "nudge", "l_tax": "qBucket"}
_DROPPED = ["nudge", "qBucket"]


@query("q_drop_vars", """
SELECT l_suppkey AS feature_id, l_shipdate AS time, l_quantity AS streamflow, l_extendedprice AS velocity
FROM lineitem""")
def q_drop_vars(spark, root):
    li = scan(spark, root, "lineitem")
    ds = li.select(*[li[c].alias(n) for c, n in _VARS.items()])
    return ds.drop(*_DROPPED)
