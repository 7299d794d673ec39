"""Forecast verification and data checks: observation join, error per site,
describe, histogram, and the allclose round-trip check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import METERS_TO_FEET, missing_as_null
from .joins import with_scalars
from ..session import checkpoint_root
from .ranking import frequencies, quantiles_of


def forecast_obs_join(fc: DataFrame, obs: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Inner equi join of forecasts and observations on ``on``; the clashing
    value columns get the suffixes ``_forecast`` and ``_gauge`` (J2, P3)."""
    f = fc.withColumnRenamed(value, f"{value}_forecast")
    o = obs.withColumnRenamed(value, f"{value}_gauge")
    return f.join(o, on, "inner")


def site_error(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Forecast in cubic feet, absolute error per row, then the mean of every
    value per group (A11, A12).  Ids are grouping keys, never averaged."""
    f3 = F.col("value_forecast") * F.lit(METERS_TO_FEET ** 3)
    rows = (merged.withColumn("value_forecast_f3", f3)
                  .withColumn("err", F.abs(F.col("value_forecast_f3") - F.col("value_gauge"))))
    vals = ["value_forecast", "value_gauge", "value_forecast_f3", "err"]
    return rows.groupBy(*keys).agg(*[F.avg(missing_as_null(v)).alias(v) for v in vals])


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, std (divisor n-1), min, quartiles (linear), max - one row."""
    checkpoint_root(df.sparkSession)
    # One pass makes (value, rows); moments and ranks both come from it.
    freq = frequencies(df.select(missing_as_null(col).alias(col)), col).checkpoint(eager=True)
    n, v = F.col("n"), F.col(col)
    mean = freq.agg((F.sum(n * v) / F.sum(n)).alias("m")).scalar()
    moments = freq.withColumn("_mean", mean).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("count"), F.max("_mean").alias("mean"),
        F.when(F.sum(n) > 1, F.sqrt(F.sum(n * (v - F.col("_mean")) ** 2) / F.nullif(F.sum(n) - 1, F.lit(0)))).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    quart = quantiles_of(freq, col, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    return with_scalars(moments, quart).select("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """``bins`` equal-width bins between min and max, last bin closed; empty
    bins kept (A14).  The range is a one-row aggregate attached by broadcast."""
    v = df.select(missing_as_null(col).alias("_v")).where(F.col("_v").isNotNull())
    rng = v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    raw = F.floor(F.lit(bins) * (F.col("_v") - F.col("_lo")) / width).cast("int") + 1
    b = F.when(width == 0, F.lit(1)).otherwise(F.least(raw, F.lit(bins)))
    counts = with_scalars(v, rng).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    all_bins = rng.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "_lo", "_hi")
    edges = all_bins.select(
        "bin", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin") - 1) / bins).alias("bin_start"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / bins).alias("bin_end"))
    return (edges.join(counts, "bin", "left")
                 .select("bin", "bin_start", "bin_end", F.coalesce("count", F.lit(0)).alias("count")))


def allclose(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str],
             rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Cell-by-cell comparison of two layouts of the same cube.

    Full outer join on the cell key; a value pair is close when
    ``|a - b| <= atol + rtol * |b|``, or both are missing (NaN equals NaN).
    One row: cells, cells missing on either side, values not close, verdict.
    """
    l = left.select(*keys, *[missing_as_null(c).alias(f"_l_{c}") for c in cols], F.lit(True).alias("_in_l"))
    r = right.select(*keys, *[missing_as_null(c).alias(f"_r_{c}") for c in cols], F.lit(True).alias("_in_r"))
    j = l.join(r, keys, "full_outer")
    bad = F.lit(False)
    for c in cols:
        a, b = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        close = (a.isNull() & b.isNull()) | (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))
        bad = bad | ~F.coalesce(close, F.lit(False))
    stats = j.agg(
        F.count(F.lit(1)).alias("nb_cells"),
        F.count_if(F.col("_in_r").isNull()).alias("nb_only_left"),
        F.count_if(F.col("_in_l").isNull()).alias("nb_only_right"),
        F.count_if(F.col("_in_l") & F.col("_in_r") & bad).alias("nb_not_close"))
    ok = (F.col("nb_only_left") == 0) & (F.col("nb_only_right") == 0) & (F.col("nb_not_close") == 0)
    return stats.withColumn("all_close", ok)
