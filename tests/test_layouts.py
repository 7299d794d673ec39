"""Layout round trips (the reference's only real check): every rewrite of the
reach cube reads back cell-for-cell equal, NaN equal to NaN."""

import pytest
from pyspark.sql import functions as F

from tributary.operators import layout as lay
from tributary.operators.verify import allclose
from tributary.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
KEY = ["feature_id", "time"]


def _check(spark, flow, back):
    r = allclose(flow, back.select("feature_id", "time", "streamflow"), KEY, ["streamflow"]).first()
    assert r.all_close and r.nb_cells == flow.count()


@pytest.mark.parametrize("shape", [lay.CHUNKS_ORIGINAL, lay.CHUNKS_TRANSPOSED, lay.CHUNKS_SQUARE, (7, 3)])
def test_chunked_round_trip(spark, tmp_dir, shape):
    flow = fx.flow(spark, SF)
    chunked = lay.with_chunk_ids(flow, *shape)
    lay.write_chunked(chunked, tmp_dir, KEY)
    back = lay.read_chunked(spark, tmp_dir)
    _check(spark, flow, back)
    # every chunk holds at most size_t time labels and size_f feature labels
    rep = lay.chunk_report(back).agg(F.max("nb_times").alias("t"), F.max("nb_features").alias("f")).first()
    assert rep.t <= shape[0] and rep.f <= shape[1]


def test_monthly_segments_sorted_round_trips(spark, tmp_dir):
    flow = fx.flow(spark, SF)
    lay.write_monthly(flow, f"{tmp_dir}/m")
    _check(spark, flow, spark.read.parquet(f"{tmp_dir}/m"))
    lay.write_segments(lay.with_segments(flow, 7), f"{tmp_dir}/s")
    back = spark.read.parquet(f"{tmp_dir}/s")
    _check(spark, flow, back)
    per_seg = back.groupBy("segment").agg(F.count_distinct("feature_id").alias("n")).collect()
    assert max(r.n for r in per_seg) <= 7
    lay.write_sorted(flow, f"{tmp_dir}/o", "feature_id")
    _check(spark, flow, spark.read.parquet(f"{tmp_dir}/o"))


def test_nan_cells_survive_a_round_trip(spark, tmp_dir):
    flow = fx.flow(spark, SF).withColumn(
        "streamflow", F.when(F.col("feature_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("streamflow")))
    lay.write_sorted(flow, tmp_dir, "feature_id")
    _check(spark, flow, spark.read.parquet(tmp_dir))


def test_reruns_leave_no_old_rows(spark, tmp_dir):
    """Another shape, cube or size into the same folder replaces what was there."""
    cube = spark.createDataFrame([(f, f"2001-{m:02d}-01", float(f * m)) for f in range(6) for m in range(1, 7)],
                                 "feature_id long, time string, streamflow double")
    cube = cube.select("feature_id", F.col("time").cast("timestamp_ntz").alias("time"), "streamflow")
    for shape in [(2, 2), (3, 3)]:
        lay.write_chunked(lay.with_chunk_ids(cube, *shape), f"{tmp_dir}/c", KEY)
    assert lay.read_chunked(spark, f"{tmp_dir}/c").count() == 36
    for part in (cube, cube.where("month(time) > 3")):
        lay.write_monthly(part, f"{tmp_dir}/m")
    assert spark.read.parquet(f"{tmp_dir}/m").count() == 18
    for size in (2, 4):
        lay.write_segments(lay.with_segments(cube, size), f"{tmp_dir}/s")
    assert spark.read.parquet(f"{tmp_dir}/s").count() == 36
    for part in (cube, cube.where("feature_id < 2")):
        lay.append_slices(part, f"{tmp_dir}/a", "feature_id")
    assert spark.read.parquet(f"{tmp_dir}/a").count() == 36


@pytest.mark.parametrize("size", [1, 10])
def test_null_labels_are_kept_at_every_size(spark, size):
    cube = spark.createDataFrame([(1, 5), (2, 5), (None, 5)], "feature_id long, time long")
    got = {r.feature_id: (r.chunk_time, r.chunk_feature) for r in lay.with_chunk_ids(cube, size, size).collect()}
    assert got == {1: (0, 0), 2: (0, 1 // size), None: (0, None)}
