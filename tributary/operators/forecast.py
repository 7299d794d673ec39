"""Forecast-cube operators over ``(feature_id, reference_time, time, <var>)``.

Spread is the population standard deviation (divisor n), so a valid time
seen by one forecast contributes 0, not NULL.  The two "average deviation"
reductions of the reference swap the axes and give different numbers; both
are kept and named after what they compute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import missing_as_null
from ..functions.time import hours_between, months_between_labels, range_instants
from ..session import shared_dir
from .joins import with_scalars
from .ranking import dense_positions

KEY = ["feature_id", "reference_time", "time"]


def spread_by_valid_time(fc: DataFrame, var: str = "streamflow") -> DataFrame:
    """Per ``(feature_id, time)``: std over reference times."""
    return fc.groupBy("feature_id", "time").agg(F.stddev_pop(missing_as_null(var)).alias("spread"))


def avg_deviation_over_ref(fc: DataFrame, var: str = "streamflow") -> DataFrame:
    """Per feature: mean over valid times of the spread across reference times."""
    return (spread_by_valid_time(fc, var).groupBy("feature_id")
            .agg(F.avg("spread").alias("avg_deviation")))


def avg_deviation_over_time(fc: DataFrame, var: str = "streamflow") -> DataFrame:
    """Per feature: std over valid times per reference time, then mean over reference times (A10)."""
    per_ref = (fc.groupBy("feature_id", "reference_time")
                 .agg(F.stddev_pop(missing_as_null(var)).alias("spread")))
    return per_ref.groupBy("feature_id").agg(F.avg("spread").alias("avg_deviation"))


def _series(fc: DataFrame, keys: list[str], axis: str, var: str) -> DataFrame:
    # One group per (feature, one axis label): its size is bounded by the
    # length of the other axis (leads per cycle, or cycles per valid time).
    pts = F.sort_array(F.collect_list(F.struct(F.col(axis).alias("t"), F.col(var).alias("v"))))
    return fc.groupBy(*keys).agg(pts.alias("series"), F.count(F.lit(1)).alias("nb_points"))


def series_by_reference(fc: DataFrame, var: str = "streamflow") -> DataFrame:
    """One series per ``(feature_id, reference_time)`` ordered by valid time."""
    return _series(fc, ["feature_id", "reference_time"], "time", var)


def series_by_valid_time(fc: DataFrame, var: str = "streamflow") -> DataFrame:
    """One series per ``(feature_id, time)`` ordered by reference time."""
    return _series(fc, ["feature_id", "time"], "reference_time", var)


def series_text(series: Column, time_format: str) -> Column:
    """Readable form of a series: ``label=value;...`` with six decimals."""
    return F.array_join(F.transform(series, lambda p: F.concat(
        F.date_format(p["t"], time_format), F.lit("="),
        F.format_string("%.6f", F.round(p["v"], 6)))), ";")


def with_lead(fc: DataFrame, unit: str = "months") -> DataFrame:
    """Add the lead of each valid time from its reference time.

    ``unit="hours"`` gives the lead hour of hourly forecast cycles;
    ``unit="months"`` counts calendar months, for monthly cubes (the bound
    test cube is monthly).
    """
    if unit == "hours":
        return fc.withColumn("lead", hours_between("time", "reference_time"))
    if unit == "months":
        return fc.withColumn("lead", months_between_labels("time", "reference_time"))
    raise ValueError(f"unknown lead unit {unit!r}")


def last_days_two_axes(fc: DataFrame, first_days_back: int, last_days_back: int) -> DataFrame:
    """Rows whose reference time and valid time both lie in
    ``[anchor - first_days_back, anchor - last_days_back]``, closed at both
    instants; the anchor is the newest reference time (P10)."""
    anchor = fc.agg(F.max("reference_time").alias("_anchor"))
    lo = F.col("_anchor") - F.make_dt_interval(F.lit(first_days_back))
    hi = F.col("_anchor") - F.make_dt_interval(F.lit(last_days_back))
    j = with_scalars(fc, anchor)
    keep = range_instants("reference_time", lo, hi) & range_instants("time", lo, hi)
    return j.where(keep).drop("_anchor")


def combine_versions(stacked: DataFrame, var: str = "streamflow", path_col: str = "path") -> DataFrame:
    """Combine stacked forecast files on ``(feature_id, reference_time, time)``;
    where two files hold a cell, the lexically last path wins (S4).

    Rows carry the place of their path in order, not its text: numbers are
    aggregated by hash, text would have every task sort all its rows.  Few
    cells come twice, so rows are dealt by cell before they are aggregated
    and a task holds the cells of its share only.
    """
    spark = stacked.sparkSession
    places = dense_positions(stacked, path_col, "_place")
    kept = shared_dir(spark, "paths")
    places.write.parquet(kept)
    placed = stacked.join(spark.read.schema(places.schema).parquet(kept), path_col, "left")
    return placed.select(*KEY, var, "_place").repartition(*[F.col(k) for k in KEY]).groupBy(*KEY).agg(F.max_by(var, "_place").alias(var))
