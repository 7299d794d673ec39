"""Edge cases of the reductions that the driver tables do not reach."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tributary.functions.time import range_closed, range_open
from tributary.operators import climatology as clim
from tributary.operators import forecast as fo
from tributary.operators.ranking import dense_positions, exact_quantiles
from tributary.operators.verify import allclose, describe, histogram

NAN = float("nan")


def _cube(spark, rows):
    return spark.createDataFrame(rows, "feature_id long, time string, streamflow double") \
        .withColumn("time", F.col("time").cast("timestamp_ntz"))


def test_nan_is_missing_in_climatology(spark):
    df = _cube(spark, [(1, "2000-01-01", 1.0), (2, "2000-01-01", NAN), (1, "2000-01-02", NAN),
                       (2, "2000-01-02", NAN)])
    out = {r.dayofyear: r.streamflow for r in clim.mean_features_mean_day(df).collect()}
    assert out[1] == 1.0          # NaN skipped
    assert out[2] is None         # all-NaN slice gives missing, not NaN


def test_iso_week_edges_and_leap_day(spark):
    df = _cube(spark, [(1, "2000-01-01", 1.0), (2, "1990-12-31", 2.0), (3, "2000-12-31", 3.0)])
    weeks = {r.streamflow: r.week for r in clim.mean_week(df).collect()}
    assert weeks[1.0] == 52 and weeks[2.0] == 1
    days = {r.streamflow: r.dayofyear for r in clim.mean_day(df).collect()}
    assert days[3.0] == 366


def test_closed_range_is_open_range_plus_end_points(spark):
    rows = [(1, t, 1.0) for t in ["1996-01-01", "1996-06-01", "1997-01-01", "1997-01-01 23:00:00", "1997-01-02"]]
    df = _cube(spark, rows)
    closed = df.where(range_closed("time", "1996-01-01", "1997-01-01")).count()
    opened = df.where(range_open("time", "1996-01-01", "1997-01-01")).count()
    assert closed == 4          # the stop label covers its whole day
    assert opened == 1


def test_single_forecast_has_zero_spread(spark):
    fc = spark.createDataFrame([(1, "2000-01-01", "2000-01-02", 5.0), (1, "2000-01-01", "2000-01-03", 7.0)],
                               "feature_id long, reference_time string, time string, streamflow double")
    fc = fc.select("feature_id", F.col("reference_time").cast("timestamp_ntz").alias("reference_time"),
                   F.col("time").cast("timestamp_ntz").alias("time"), "streamflow")
    assert {r.spread for r in fo.spread_by_valid_time(fc).collect()} == {0.0}
    assert fo.avg_deviation_over_ref(fc).first().avg_deviation == 0.0
    assert fo.avg_deviation_over_time(fc).first().avg_deviation == 1.0


def test_constant_series_has_zero_spread(spark):
    rows = [(1, f"2000-01-{d:02d}", f"2000-02-{d:02d}", 3.0) for d in range(1, 20)]
    fc = spark.createDataFrame(rows, "feature_id long, reference_time string, time string, streamflow double")
    fc = fc.select("feature_id", F.col("reference_time").cast("timestamp_ntz").alias("reference_time"),
                   F.col("time").cast("timestamp_ntz").alias("time"), "streamflow")
    assert fo.avg_deviation_over_time(fc).first().avg_deviation == 0.0


def test_positions_match_brute_force_with_many_buckets(spark):
    rnd = random.Random(3)
    vals = [rnd.randint(0, 500) for _ in range(3000)] + [42] * 2000   # one hot label
    df = spark.createDataFrame([(v,) for v in vals], "t long")
    got = {r.t: r.pos for r in dense_positions(df, "t", "pos", n_buckets=7).collect()}
    want = {v: i for i, v in enumerate(sorted(set(vals)))}
    assert got == want


def test_exact_quantiles_match_numpy_with_hot_value(spark):
    rnd = random.Random(5)
    vals = [rnd.gauss(0, 10) for _ in range(4001)] + [1.5] * 3000
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    row = exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.75, 0.99], ["a", "b", "c", "d", "e"], n_buckets=9).first()
    want = np.quantile(np.array(vals), [0.1, 0.25, 0.5, 0.75, 0.99])
    assert np.allclose([row.a, row.b, row.c, row.d, row.e], want, rtol=0, atol=1e-12)


def test_describe_uses_sample_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "value double")
    r = describe(df, "value").first()
    assert r["count"] == 4 and math.isclose(r["std"], np.std([1, 2, 3, 4], ddof=1))
    assert (r.p25, r.p50, r.p75) == (1.75, 2.5, 3.25)


def test_histogram_keeps_empty_bins_and_closes_last(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (1.0,)], "value double")
    h = {r.bin: r["count"] for r in histogram(df, "value", 10).collect()}
    assert len(h) == 10 and h[1] == 2 and h[10] == 1 and sum(h.values()) == 3


def test_allclose_tolerance_and_missing_cells(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, NAN), (4, 4.0)], "k long, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-9), (2, 2.5), (3, NAN), (5, 5.0)], "k long, v double")
    r = allclose(a, b, ["k"], ["v"]).first()
    assert (r.nb_cells, r.nb_only_left, r.nb_only_right, r.nb_not_close, r.all_close) == (5, 1, 1, 1, False)
    same = allclose(a, a, ["k"], ["v"]).first()
    assert same.all_close


def test_positions_with_many_buckets(spark):
    vals = list(range(0, 30000, 3))
    df = spark.createDataFrame([(v,) for v in vals], "t long")
    got = {r.t: r.pos for r in dense_positions(df, "t", "pos", n_buckets=300).collect()}
    assert got == {v: i for i, v in enumerate(vals)}


def test_mean_of_means_equals_pooled_mean_only_on_dense_cubes(spark):
    """A1 (mean over features, then over times) equals A4 (pooled) when every
    time holds the same features; on a ragged cube they differ."""
    dense = [(f, f"2001-03-{d:02d}", float(f * d)) for f in range(1, 5) for d in range(1, 8)]
    df = _cube(spark, dense)
    a1 = {r.dayofyear: r.streamflow for r in clim.mean_features_mean_day(df).collect()}
    a4 = {r.dayofyear: r.streamflow for r in clim.pooled_day(df).collect()}
    assert a1.keys() == a4.keys() and all(abs(a1[k] - a4[k]) < 1e-12 for k in a1)
    ragged = _cube(spark, [(1, "2001-03-01", 1.0), (2, "2001-03-01", 3.0), (1, "2002-03-01", 10.0)])
    r1 = {r.dayofyear: r.streamflow for r in clim.mean_features_mean_day(ragged).collect()}
    r4 = {r.dayofyear: r.streamflow for r in clim.pooled_day(ragged).collect()}
    assert r1[60] == (2.0 + 10.0) / 2 and r4[60] == (1.0 + 3.0 + 10.0) / 3


def test_lead_in_hours_and_months(spark):
    fc = spark.createDataFrame([(1, "2022-01-05 07:00:00", "2022-01-05 19:00:00", 1.0),
                                (1, "2022-01-31 23:00:00", "2022-03-01 00:00:00", 2.0)],
                               "feature_id long, reference_time string, time string, streamflow double")
    fc = fc.select("feature_id", F.col("reference_time").cast("timestamp_ntz").alias("reference_time"),
                   F.col("time").cast("timestamp_ntz").alias("time"), "streamflow")
    hours = {r.streamflow: r.lead for r in fo.with_lead(fc, "hours").collect()}
    months = {r.streamflow: r.lead for r in fo.with_lead(fc, "months").collect()}
    assert hours == {1.0: 12, 2.0: 673} and months == {1.0: 0, 2.0: 2}  # Feb 2022: 28 days


def test_positions_in_the_native_type(spark):
    """Big integers, text, dates and decimals keep their own order."""
    from datetime import date, timedelta
    from decimal import Decimal
    cases = [("long", [2 ** 53 + i for i in range(40)]), ("string", [f"{c}{i}" for c in "zaBÄ" for i in range(12)]),
             ("date", [date(1900, 1, 1) + timedelta(days=97 * i) for i in range(60)]),
             ("decimal(38,10)", [Decimal(10) ** 20 + Decimal(i) / 7 for i in range(30)]), ("double", [1e300, -1e-300, 0.1, 3.0])]
    for kind, values in cases:
        df = spark.createDataFrame([(v,) for v in values * 2], f"t {kind}")
        got = {r.t: r.pos for r in dense_positions(df, "t", "pos", n_buckets=6).collect()}
        order = sorted(got, key=lambda v: v.encode() if isinstance(v, str) else v)
        assert [got[v] for v in order] == list(range(len(order))), kind


def test_more_buckets_than_the_sample_serves(spark, monkeypatch):
    from tributary.operators import ranking
    monkeypatch.setattr(ranking, "SAMPLE_LABELS", 64)
    monkeypatch.setattr(ranking, "VALUES_PER_BUCKET", 20)
    df = spark.range(0, 9000, 3).withColumnRenamed("id", "t")
    assert len(ranking.label_bounds(df, ["t"])["t"]) > 64
    assert {r.t: r.pos for r in dense_positions(df, "t").collect()} == {v: i for i, v in enumerate(range(0, 9000, 3))}


def test_combined_files_aggregate_numbers_and_the_last_path_wins(spark):
    from tributary.operators import forecast as fo
    rows = [(1, 0, 5, 1.0, "a/9"), (1, 0, 5, 2.0, "b/1"), (1, 0, 5, 3.0, "B/7"), (1, 1, 5, None, "b/1"), (1, 1, 5, 4.0, "a/9"), (2, 0, 5, 6.0, None)]
    out = fo.combine_versions(spark.createDataFrame(rows, "feature_id long, reference_time long, time long, streamflow double, path string"))
    assert sorted(map(tuple, out.collect())) == [(1, 0, 5, 2.0), (1, 1, 5, None), (2, 0, 5, None)]
    # text among the aggregates would have every task sort all its rows
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
