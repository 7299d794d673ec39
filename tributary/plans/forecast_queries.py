"""Named queries over the forecast cube."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as fo
from ..operators.ids import subset_ids
from ..session import shared_dir
from ..sources import fixtures as fx
from ..sources.files import list_objects, read_stacked, read_stacked_first, write_by_label
from .common import SQL_AREA_IDS, rounded, study_ids
from .registry import query

# The relative evaluation window, in days back from the newest
# reference time, and the value added to re-delivered forecast files.
WINDOW_FIRST_DAYS_BACK = 150
WINDOW_LAST_DAYS_BACK = 60
REDELIVERY_OFFSET = 0.5


def study_forecast(spark, root):
    return subset_ids(fx.forecast(spark, root), study_ids(spark, root))


_SQL_FC = f"SELECT * FROM forecast WHERE feature_id IN {SQL_AREA_IDS}"


@query("q_spread_by_valid_time", f"""
SELECT feature_id, time, round(stddev_pop(streamflow), 6) AS spread FROM ({_SQL_FC}) GROUP BY 1, 2""")
def q_spread_by_valid_time(spark, root):
    return rounded(fo.spread_by_valid_time(study_forecast(spark, root)))


@query("q_avg_deviation_over_ref", f"""
WITH s AS (SELECT feature_id, time, stddev_pop(streamflow) AS spread FROM ({_SQL_FC}) GROUP BY 1, 2)
SELECT feature_id, round(avg(spread), 6) AS avg_deviation FROM s GROUP BY 1""")
def q_avg_deviation_over_ref(spark, root):
    return rounded(fo.avg_deviation_over_ref(study_forecast(spark, root)))


_SQL_DEV_TIME = f"""
WITH s AS (SELECT feature_id, reference_time, stddev_pop(streamflow) AS spread FROM ({_SQL_FC}) GROUP BY 1, 2)
SELECT feature_id, avg(spread) AS avg_deviation FROM s GROUP BY 1"""


@query("q_avg_deviation_over_time", f"""
SELECT feature_id, round(avg_deviation, 6) AS avg_deviation FROM ({_SQL_DEV_TIME})""")
def q_avg_deviation_over_time(spark, root):
    return rounded(fo.avg_deviation_over_time(study_forecast(spark, root)))


@query("q_reach_result_join", f"""
SELECT r.comid, r.huc_key, round(d.avg_deviation, 6) AS avg_deviation
FROM reach r JOIN ({_SQL_DEV_TIME}) d ON r.comid = d.feature_id""")
def q_reach_result_join(spark, root):
    dev = fo.avg_deviation_over_time(study_forecast(spark, root))
    reach = fx.reach(spark, root)
    return rounded(reach.join(dev, reach.comid == dev.feature_id).select("comid", "huc_key", "avg_deviation"))


@query("q_series_by_reference", f"""
SELECT feature_id, reference_time,
       string_agg(strftime(time, '%Y-%m') || '=' || printf('%.6f', round(streamflow, 6)), ';' ORDER BY time) AS series,
       count(*) AS nb_points
FROM ({_SQL_FC}) GROUP BY 1, 2""")
def q_series_by_reference(spark, root):
    s = fo.series_by_reference(study_forecast(spark, root))
    return s.select("feature_id", "reference_time", fo.series_text(F.col("series"), "yyyy-MM").alias("series"),
                    "nb_points")


@query("q_series_by_valid_time", f"""
SELECT feature_id, time,
       string_agg(strftime(reference_time, '%Y-%m') || '=' || printf('%.6f', round(streamflow, 6)), ';'
                  ORDER BY reference_time) AS series,
       count(*) AS nb_points
FROM ({_SQL_FC}) GROUP BY 1, 2""")
def q_series_by_valid_time(spark, root):
    s = fo.series_by_valid_time(study_forecast(spark, root))
    return s.select("feature_id", "time", fo.series_text(F.col("series"), "yyyy-MM").alias("series"), "nb_points")


@query("q_lead_hour", """
SELECT feature_id, reference_time, time, round(streamflow, 6) AS streamflow,
       CAST((year(time) - year(reference_time)) * 12 + month(time) - month(reference_time) AS INTEGER) AS lead
FROM forecast""")
def q_lead_hour(spark, root):
    return rounded(fo.with_lead(fx.forecast(spark, root)))


@query("q_lead_hours_hourly", """
SELECT feature_id, reference_time, time, round(streamflow, 6) AS streamflow,
       CAST(date_diff('hour', reference_time, time) AS INTEGER) AS lead
FROM forecast_hourly""")
def q_lead_hours_hourly(spark, root):
    """Hourly cycles keyed by lead hour."""
    out = fo.with_lead(fx.forecast_hourly(spark, root), unit="hours")
    return rounded(out.withColumn("lead", F.col("lead").cast("int")))


@query("q_last_days_two_axes", f"""
WITH fc AS ({_SQL_FC}), a AS (SELECT max(reference_time) AS anchor FROM fc)
SELECT feature_id, reference_time, time, round(streamflow, 6) AS streamflow FROM fc, a
WHERE reference_time BETWEEN anchor - INTERVAL {WINDOW_FIRST_DAYS_BACK} DAY AND anchor - INTERVAL {WINDOW_LAST_DAYS_BACK} DAY
  AND time BETWEEN anchor - INTERVAL {WINDOW_FIRST_DAYS_BACK} DAY AND anchor - INTERVAL {WINDOW_LAST_DAYS_BACK} DAY""")
def q_last_days_two_axes(spark, root):
    fc = study_forecast(spark, root)
    return rounded(fo.last_days_two_axes(fc, WINDOW_FIRST_DAYS_BACK, WINDOW_LAST_DAYS_BACK))


def _land_forecast(spark, root, path, fc):
    """Write forecast rows as one folder of files per reference time."""
    out = fc.withColumn("ref", F.date_format("reference_time", "yyyyMMdd")).drop("reference_time")
    write_by_label(out, path, "ref", mode="append", order_cols=["feature_id", "time"])


@query("q_stack_files", """
SELECT feature_id, reference_time, time, round(streamflow, 6) AS streamflow FROM forecast""")
def q_stack_files(spark, root):
    path = shared_dir(spark, "stack_files")
    _land_forecast(spark, root, path, fx.forecast(spark, root))
    st = read_stacked(spark, path, r"ref=(\d{8})", "reference_time", "yyyyMMdd")
    return rounded(st.select("feature_id", "reference_time", "time", "streamflow"))


@query("q_stack_first_coords", """
WITH first AS (SELECT DISTINCT feature_id, CAST(feature_id AS DOUBLE) + month(reference_time) / CAST(100 AS DOUBLE) AS elevation
               FROM forecast WHERE reference_time = (SELECT min(reference_time) FROM forecast))
SELECT f.feature_id, reference_time, time, round(streamflow, 6) AS streamflow, round(elevation, 6) AS elevation
FROM forecast f LEFT JOIN first USING (feature_id)""")
def q_stack_first_coords(spark, root):
    """Stacked files that disagree on a coordinate: the first file's holds."""
    path = shared_dir(spark, "stack_first")
    elevation = F.col("feature_id").cast("double") + F.month("reference_time") / 100
    _land_forecast(spark, root, path, fx.forecast(spark, root).withColumn("elevation", elevation))
    st = read_stacked_first(spark, path, r"ref=(\d{8})", "reference_time", "feature_id", ["elevation"], "yyyyMMdd")
    return rounded(st.select("feature_id", "reference_time", "time", "streamflow", "elevation"))


@query("q_list_objects", """
SELECT DISTINCT strftime(reference_time, '%Y%m%d') AS ref FROM forecast""")
def q_list_objects(spark, root):
    """Object listing of landed forecast files: one folder per reference time."""
    path = shared_dir(spark, "list_objects")
    _land_forecast(spark, root, path, fx.forecast(spark, root))
    files = list_objects(spark, path, suffix=".parquet").where(F.col("length") > 0)
    return files.select(F.regexp_extract("path", r"ref=(\d{8})", 1).alias("ref")).distinct()


@query("q_combined_forecast", f"""
SELECT feature_id, reference_time, time,
       round(CASE WHEN month(reference_time) % 2 = 1 THEN streamflow + {REDELIVERY_OFFSET} ELSE streamflow END, 6)
       AS streamflow
FROM forecast""")
def q_combined_forecast(spark, root):
    path = shared_dir(spark, "combined_forecast")
    fc = fx.forecast(spark, root)
    _land_forecast(spark, root, f"{path}/delivery=a", fc)
    again = (fc.where(F.month("reference_time") % 2 == 1)
               .withColumn("streamflow", F.col("streamflow") + REDELIVERY_OFFSET))
    _land_forecast(spark, root, f"{path}/delivery=b", again)
    st = read_stacked(spark, path, r"ref=(\d{8})", "reference_time", "yyyyMMdd")
    return rounded(fo.combine_versions(st))
