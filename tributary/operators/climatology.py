"""Climatology reductions over a reach cube ``(feature_id, time, <var>)``.

Two families share names in the reference and differ in meaning; both are
kept under distinct functions:

* cube family - ``mean_features_mean_day`` is a mean of per-time means
  (A1); ``mean_day``/``mean_week`` keep ``feature_id`` (A2, A3).
* table family - ``pooled_day``/``pooled_week`` pool every row (A4, A5).

Every reduction skips NaN (NaN is read as missing).  Each is one or two
hash aggregates with map-side partial aggregation; the shuffle carries one
partial row per group and map task, not the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import missing_as_null
from ..functions.time import day_of_year, iso_week


def mean_features_mean_day(cube: DataFrame, var: str = "streamflow") -> DataFrame:
    """Per time: mean over features; then per day of year: mean over times (A1)."""
    per_time = cube.groupBy("time").agg(F.avg(missing_as_null(var)).alias(var))
    return per_time.groupBy(day_of_year("time").alias("dayofyear")).agg(F.avg(var).alias(var))


def mean_day(cube: DataFrame, var: str = "streamflow") -> DataFrame:
    """Per ``(feature_id, day of year)`` mean."""
    return (cube.groupBy("feature_id", day_of_year("time").alias("dayofyear"))
                .agg(F.avg(missing_as_null(var)).alias(var)))


def mean_week(cube: DataFrame, var: str = "streamflow") -> DataFrame:
    """Per ``(feature_id, ISO week)`` mean (A3)."""
    return (cube.groupBy("feature_id", iso_week("time").alias("week"))
                .agg(F.avg(missing_as_null(var)).alias(var)))


def pooled_day(table: DataFrame, var: str = "streamflow") -> DataFrame:
    """Per day of year mean over all rows (A4)."""
    return table.groupBy(day_of_year("time").alias("dayofyear")).agg(F.avg(missing_as_null(var)).alias(var))


def pooled_week(table: DataFrame, var: str = "streamflow") -> DataFrame:
    """Per ISO week mean over all rows (A5)."""
    return table.groupBy(iso_week("time").alias("week")).agg(F.avg(missing_as_null(var)).alias(var))


def base_flow(cube: DataFrame, since: str, var: str = "streamflow") -> DataFrame:
    """From ``since`` on: mean and population standard deviation per ``(feature_id, week)``."""
    v = missing_as_null(var)
    return (cube.where(F.col("time") >= F.lit(since).cast("timestamp_ntz"))
                .groupBy("feature_id", iso_week("time").alias("week"))
                .agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")))


def mean_all_numeric(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of every numeric non-key column per group, columns keep their names."""
    numeric = [f.name for f in df.schema.fields
               if f.name not in keys and f.dataType.typeName() in
               ("integer", "long", "short", "byte", "float", "double", "decimal")]
    return df.groupBy(*keys).agg(*[F.avg(missing_as_null(F.col(c).cast("double"))).alias(c) for c in numeric])


def global_mean(df: DataFrame, var: str = "streamflow") -> DataFrame:
    """Mean of a whole variable, one row."""
    return df.agg(F.avg(missing_as_null(var)).alias(var))
