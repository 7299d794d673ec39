"""Named queries: forecast verification at gauges and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verify as vf
from ..operators.layout import write_sorted
from ..session import shared_dir
from ..sources import fixtures as fx
from .common import rounded
from .registry import query


def _good_gauge(spark, root):
    return fx.gauge(spark, root).where(F.col("value") >= 0)  # quality filter (P14)


def _merged(spark, root):
    sites = fx.gauge(spark, root).select("site").distinct()
    fc = fx.gauge_forecast(spark, root).join(sites, "site", "left_semi")
    return vf.forecast_obs_join(fc, _good_gauge(spark, root), ["site", "value_date"])


_SQL_MERGED = """(SELECT f.site, f.value_date, f.value AS value_forecast, g.value AS value_gauge, f.nwm_feature_id
 FROM gauge_forecast f JOIN gauge g ON f.site = g.site AND f.value_date = g.value_date
 WHERE g.value >= 0 AND f.site IN (SELECT site FROM gauge))"""


@query("q_forecast_obs_join", f"""
SELECT site, value_date, round(value_forecast, 6) AS value_forecast, round(value_gauge, 6) AS value_gauge,
       nwm_feature_id FROM {_SQL_MERGED}""")
def q_forecast_obs_join(spark, root):
    return rounded(_merged(spark, root).select("site", "value_date", "value_forecast", "value_gauge",
                                               "nwm_feature_id"))


@query("q_sites_semi", """
SELECT site, nwm_feature_id, value_date, round(value, 6) AS value FROM gauge_forecast
WHERE site IN (SELECT site FROM gauge)""")
def q_sites_semi(spark, root):
    sites = fx.gauge(spark, root).select("site").distinct()
    return rounded(fx.gauge_forecast(spark, root).join(sites, "site", "left_semi"))


@query("q_distinct_sites", "SELECT DISTINCT site FROM gauge")
def q_distinct_sites(spark, root):
    return fx.gauge(spark, root).select("site").distinct()


@query("q_site_mae", f"""
SELECT site, nwm_feature_id, round(avg(value_forecast), 6) AS value_forecast,
       round(avg(value_gauge), 6) AS value_gauge,
       round(avg(value_forecast * pow(3.28084, 3)), 6) AS value_forecast_f3,
       round(avg(abs(value_forecast * pow(3.28084, 3) - value_gauge)), 6) AS err
FROM {_SQL_MERGED} GROUP BY 1, 2""")
def q_site_mae(spark, root):
    return rounded(vf.site_error(_merged(spark, root), ["site", "nwm_feature_id"]))


@query("q_describe", """
SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
       round(max(value), 6) AS max
FROM gauge""")
def q_describe(spark, root):
    return rounded(vf.describe(fx.gauge(spark, root), "value"))


@query("q_histogram", """
WITH v AS (SELECT value FROM gauge WHERE value >= 0),
s AS (SELECT min(value) AS lo, max(value) AS hi FROM v),
c AS (SELECT least(CAST(floor(10 * (value - lo) / (hi - lo)) AS INTEGER) + 1, 10) AS bin, count(*) AS n
      FROM v, s GROUP BY 1),
b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 11))
SELECT b.bin, round(lo + (hi - lo) * (b.bin - 1) / 10, 6) AS bin_start, round(lo + (hi - lo) * b.bin / 10, 6) AS bin_end,
       coalesce(c.n, 0) AS count
FROM b CROSS JOIN s LEFT JOIN c ON b.bin = c.bin""")
def q_histogram(spark, root):
    return rounded(vf.histogram(_good_gauge(spark, root), "value", 10))


@query("q_allclose", """
SELECT count(*) AS nb_cells, CAST(0 AS BIGINT) AS nb_only_left, CAST(0 AS BIGINT) AS nb_only_right,
       CAST(0 AS BIGINT) AS nb_not_close, true AS all_close FROM flow""")
def q_allclose(spark, root):
    flow = fx.flow(spark, root)
    path = shared_dir(spark, "allclose")
    write_sorted(flow, path, "feature_id")
    copy = spark.read.parquet(path)
    return vf.allclose(flow, copy, ["feature_id", "time"], ["streamflow"])
