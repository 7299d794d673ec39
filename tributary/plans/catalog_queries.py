"""Named queries over the forecast-file catalogs and path/date/URL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import base_name, parse_forecast_path, path_key, with_extension
from ..operators import catalog as cat
from ..session import shared_dir
from ..sources import fixtures as fx
from ..sources.tables import scan
from ..streaming.refresh import published, read_artifact, refresh_once
from .common import CYCLES, LEADS, RETENTION_DAYS, dates_as_timestamps
from .registry import query

# Listing prefix/suffix, and the base date and offset of the
# date arithmetic query.
LIST_PREFIX = "nwm.199601"
LIST_SUFFIX = ".conus.nc"
DATE_BASE = "1995-01-01"
DATE_BACK_DAYS = 5

_SQL_KEY = r"regexp_extract(regexp_replace(path, '\.[^.]*$', ''), '([^/]*/[^/]*/[^/]*)$', 1)"
_SQL_DATE = r"CAST(strptime(regexp_extract(path, 'nwm\.(\d{8})', 1), '%Y%m%d') AS DATE)"
_SQL_CYCLE = r"CAST(regexp_extract(path, '\.t(\d{2})z\.', 1) AS INTEGER)"
_SQL_LEAD = r"CAST(regexp_extract(path, '\.f(\d{3})\.', 1) AS INTEGER)"
_SQL_REF = f"(CAST({_SQL_DATE} AS TIMESTAMP) + to_hours({_SQL_CYCLE}))"
_SQL_KEPT = f"""(SELECT path, {_SQL_DATE} AS folder_date FROM catalog_src
 WHERE {_SQL_DATE} >= (SELECT max({_SQL_DATE}) FROM catalog_src) - {RETENTION_DAYS})"""
_SQL_EXPECTED = f"""(SELECT folder_date, CAST(c.cycle AS INTEGER) AS cycle, CAST(l.lead AS INTEGER) AS lead,
 'nwm.' || strftime(folder_date, '%Y%m%d') || '/short_range/nwm.t' || lpad(CAST(c.cycle AS VARCHAR), 2, '0')
 || 'z.short_range.channel_rt.f' || lpad(CAST(l.lead AS VARCHAR), 3, '0') || '.conus.nc' AS path
 FROM (SELECT DISTINCT folder_date FROM {_SQL_KEPT}) d, range(0, {CYCLES}) c(cycle), range(1, {LEADS + 1}) l(lead))"""


@query("q_catalog_diff", f"""
SELECT 'create' AS action, path FROM catalog_src
WHERE {_SQL_KEY} NOT IN (SELECT {_SQL_KEY} FROM catalog_dst)
UNION ALL
SELECT 'delete' AS action, path FROM catalog_dst
WHERE {_SQL_KEY} NOT IN (SELECT {_SQL_KEY} FROM catalog_src)""")
def q_catalog_diff(spark, root):
    return cat.catalog_diff(fx.catalog_src(spark, root), fx.catalog_dst(spark, root))


@query("q_refresh_rerun", f"""
SELECT 'create' AS action, path FROM {_SQL_KEPT} WHERE {_SQL_KEY} NOT IN (SELECT {_SQL_KEY} FROM catalog_dst)""")
def q_refresh_rerun(spark, root):
    """The refresh job run twice into one folder, the second time without
    stale index files: none of the first run's deletions is left."""
    src, dst, out = fx.catalog_src(spark, root), fx.catalog_dst(spark, root), shared_dir(spark, "refresh")
    refresh_once(src, dst, out, RETENTION_DAYS, CYCLES, LEADS)
    kept = cat.keep_recent_days(src, RETENTION_DAYS).select(path_key("path").alias("key"))
    current = dst.withColumn("key", path_key("path")).join(kept, "key", "left_semi").select("path")
    refresh_once(src, current, out, RETENTION_DAYS, CYCLES, LEADS)
    return read_artifact(spark, published(spark, out), "diff").select("action", "path")


@query("q_retention", f"SELECT path, CAST(folder_date AS TIMESTAMP) AS folder_date FROM {_SQL_KEPT}")
def q_retention(spark, root):
    return dates_as_timestamps(cat.keep_recent_days(fx.catalog_src(spark, root), RETENTION_DAYS))


@query("q_manifest", f"""
SELECT {_SQL_REF} AS reference_time, {_SQL_REF} + to_hours({_SQL_LEAD}) AS time, {_SQL_LEAD} AS lead, path
FROM catalog_src""")
def q_manifest(spark, root):
    return cat.manifest(fx.catalog_src(spark, root))


@query("q_expected_files", f"SELECT CAST(folder_date AS TIMESTAMP) AS folder_date, cycle, lead, path FROM {_SQL_EXPECTED}")
def q_expected_files(spark, root):
    kept = cat.keep_recent_days(fx.catalog_src(spark, root), RETENTION_DAYS)
    return dates_as_timestamps(cat.expected_files(kept, CYCLES, LEADS))


@query("q_missing_files", f"""
SELECT CAST(folder_date AS TIMESTAMP) AS folder_date, cycle, lead, path FROM {_SQL_EXPECTED} e
WHERE e.path NOT IN (SELECT path FROM catalog_src)""")
def q_missing_files(spark, root):
    src = fx.catalog_src(spark, root)
    expected = cat.expected_files(cat.keep_recent_days(src, RETENTION_DAYS), CYCLES, LEADS)
    return dates_as_timestamps(cat.missing_files(expected, src))


@query("q_parse_forecast_path", f"""
SELECT path, CAST({_SQL_DATE} AS TIMESTAMP) AS date, {_SQL_CYCLE} AS cycle,
       regexp_extract(path, '\\.short_range\\.([a-z_]+)\\.f\\d{{3}}\\.', 1) AS forecast_type,
       {_SQL_LEAD} AS lead, {_SQL_REF} AS reference_time, {_SQL_REF} + to_hours({_SQL_LEAD}) AS valid_time
FROM catalog_src""")
def q_parse_forecast_path(spark, root):
    p = parse_forecast_path("path")
    return dates_as_timestamps(fx.catalog_src(spark, root).select("path", *[c.alias(n) for n, c in p.items()]))


@query("q_path_key", f"""
SELECT path, {_SQL_KEY} AS key FROM catalog_src UNION ALL SELECT path, {_SQL_KEY} AS key FROM catalog_dst""")
def q_path_key(spark, root):
    both = fx.catalog_src(spark, root).unionByName(fx.catalog_dst(spark, root))
    return both.select("path", path_key("path").alias("key"))


@query("q_path_names", r"""
SELECT path, regexp_extract(path, '([^/]*)$', 1) AS base_name,
       regexp_replace(path, '([^/])\.[^./]*$', '\1') || '.json' AS index_path FROM catalog_src""")
def q_path_names(spark, root):
    """Name of each source file and path of the index file made from it."""
    return fx.catalog_src(spark, root).select("path", base_name("path").alias("base_name"),
                                              with_extension("path", "json").alias("index_path"))


@query("q_list_by_prefix", f"""
SELECT path FROM catalog_src WHERE starts_with(path, '{LIST_PREFIX}') AND ends_with(path, '{LIST_SUFFIX}')""")
def q_list_by_prefix(spark, root):
    return cat.list_by_name(fx.catalog_src(spark, root), LIST_PREFIX, LIST_SUFFIX)


@query("q_date_functions", f"""
WITH r AS (SELECT DISTINCT {_SQL_REF} AS reference_time FROM catalog_src)
SELECT reference_time, CAST(CAST(reference_time AS DATE) AS TIMESTAMP) AS day,
       CAST(CAST(CAST(reference_time AS DATE) - INTERVAL {DATE_BACK_DAYS} DAY AS DATE) AS TIMESTAMP) AS day_back,
       CAST(date_diff('day', DATE '{DATE_BASE}', CAST(reference_time AS DATE)) AS INTEGER) AS days_since_base,
       strftime(reference_time, '%Y%m%d') AS folder_label,
       strftime(reference_time, '%m-%d %H') AS plot_label,
       strftime(reference_time, '%Y%m%dT%-HZ') AS request_label,
       reference_time - INTERVAL 1 DAY AS day_before
FROM r""")
def q_date_functions(spark, root):
    ref = cat.manifest(fx.catalog_src(spark, root)).select("reference_time").distinct()
    day = F.to_date("reference_time")
    return dates_as_timestamps(ref.select(
        "reference_time", day.alias("day"), F.date_sub(day, DATE_BACK_DAYS).alias("day_back"),
        F.datediff(day, F.to_date(F.lit(DATE_BASE))).alias("days_since_base"),
        F.date_format("reference_time", "yyyyMMdd").alias("folder_label"),
        F.date_format("reference_time", "MM-dd HH").alias("plot_label"),
        F.date_format("reference_time", "yyyyMMdd'T'H'Z'").alias("request_label"),
        (F.col("reference_time") - F.expr("INTERVAL 1 DAY")).alias("day_before")))


@query("q_parse_url", r"""
SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) AS host,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
FROM pages""")
def q_parse_url(spark, root):
    pg = scan(spark, root, "pages")
    return pg.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"),
                     F.parse_url("url", F.lit("PATH")).alias("path"))
