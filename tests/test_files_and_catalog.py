"""Sources, sinks, file names and catalogs."""

import os

from pyspark.sql import functions as F

from tributary.functions.paths import base_name, parse_forecast_path, path_key, with_extension
from tributary.operators import catalog as cat
from tributary.operators import layout as lay
from tributary.sources.files import list_objects, read_stacked, read_stacked_first, write_by_label
from tributary.streaming.incremental import ingest_new_files


def test_path_key_and_parse(spark):
    df = spark.createDataFrame([("s3://b/nwm.20220105/short_range/nwm.t07z.short_range.channel_rt.f012.conus.nc",),
                                ("kerchunk/nwm.20220105/short_range/nwm.t07z.short_range.channel_rt.f012.conus.json",)],
                               "path string")
    keys = {r.k for r in df.select(path_key("path").alias("k")).collect()}
    assert keys == {"nwm.20220105/short_range/nwm.t07z.short_range.channel_rt.f012.conus"}
    p = parse_forecast_path("path")
    r = df.select(*[c.alias(n) for n, c in p.items()]).first()
    assert (r.cycle, r.lead, r.forecast_type) == (7, 12, "channel_rt")
    assert str(r.reference_time) == "2022-01-05 07:00:00" and str(r.valid_time) == "2022-01-05 19:00:00"


def test_base_name_and_extension(spark):
    cases = {"a.b/c": ("c", "a.b/c.json"), "a/c.nc": ("c.nc", "a/c.json"), "c.tar.gz": ("c.tar.gz", "c.tar.json"),
             "a/.hidden": (".hidden", "a/.hidden.json"), "a/": ("", "a/.json"), None: (None, None)}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    got = df.select("path", base_name("path").alias("b"), with_extension("path", "json").alias("e")).collect()
    assert {r.path: (r.b, r.e) for r in got} == cases


def test_coordinates_come_from_the_first_file(spark, tmp_dir):
    def land(ref, data):
        spark.createDataFrame(data, "id long, v double, lat double, note string").repartition(2).write.parquet(f"{tmp_dir}/ref={ref}")
    land("20200102", [(1, 1.0, 99.0, "x"), (2, 2.0, 98.0, "x"), (3, 3.0, 97.0, "x"), (None, 4.0, 96.0, "x")])
    land("20200101", [(1, 5.0, 10.0, "x"), (2, 6.0, None, "x"), (1, 7.0, 10.0, "x")])
    spark.createDataFrame([(1, 8.0, 1.0, "x")], "id long, v double, lat double, note string").write.parquet(f"{tmp_dir}/a_stray")
    got = read_stacked_first(spark, tmp_dir, r"ref=(\d{8})", "ref", "id", ["lat"])
    assert sorted(((r.ref, r.id, r.v, r.lat) for r in got.collect()), key=str) == sorted([
        ("20200102", 1, 1.0, 10.0), ("20200102", 2, 2.0, None), ("20200102", 3, 3.0, None), ("20200102", None, 4.0, None),
        ("20200101", 1, 5.0, 10.0), ("20200101", 2, 6.0, None), ("20200101", 1, 7.0, 10.0), ("", 1, 8.0, 10.0)], key=str)


def test_retention_keeps_n_plus_one_days(spark):
    paths = [(f"nwm.202201{d:02d}/short_range/x.nc",) for d in range(1, 32)]
    kept = cat.keep_recent_days(spark.createDataFrame(paths, "path string"), 28)
    assert kept.count() == 29


def test_listing_by_prefix_and_suffix(spark, tmp_dir):
    for name in ["nwm.a.nc", "nwm.b.nc", "other.nc", "nwm.c.json"]:
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write("x")
    got = {os.path.basename(r.path) for r in list_objects(spark, tmp_dir, "nwm.", ".nc").collect()}
    assert got == {"nwm.a.nc", "nwm.b.nc"}


def test_stacked_files_take_label_from_name(spark, tmp_dir):
    df = spark.createDataFrame([(1, "19990101", 1.0), (2, "19990102", 2.0)], "feature_id long, ref string, v double")
    write_by_label(df, tmp_dir, "ref")
    st = read_stacked(spark, tmp_dir, r"ref=(\d{8})", "reference_time", "yyyyMMdd")
    got = {(r.feature_id, str(r.reference_time)) for r in st.collect()}
    assert got == {(1, "1999-01-01 00:00:00"), (2, "1999-01-02 00:00:00")}


def test_two_axis_rerun_is_idempotent(spark, tmp_dir):
    df = spark.createDataFrame([(c, l, float(c * l)) for c in range(3) for l in range(1, 4)],
                               "cycle int, lead int, v double")
    lay.write_two_axis(df, tmp_dir, "cycle", "lead")
    lay.write_two_axis(df.where(F.col("lead") == 2).withColumn("v", F.lit(-1.0)), tmp_dir, "cycle", "lead")
    back = spark.read.parquet(tmp_dir)
    assert back.count() == 9
    assert back.where(F.col("v") == -1.0).count() == 3


def test_sorted_layout_prunes_row_groups(spark, tmp_dir):
    df = spark.range(0, 20000).withColumn("v", F.col("id") * 2.0)
    lay.write_sorted(df, tmp_dir, "id")
    plan = spark.read.parquet(tmp_dir).where(F.col("id") == 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(id,5)" in plan


def test_incremental_ingest_reads_each_file_once(spark, tmp_dir):
    landing, sink, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    schema = "k long, v double"
    spark.createDataFrame([(1, 1.0), (2, 2.0)], schema).write.parquet(f"{landing}/a")
    ingest_new_files(spark, landing, sink, ckpt, schema)
    assert spark.read.parquet(sink).count() == 2
    ingest_new_files(spark, landing, sink, ckpt, schema)
    assert spark.read.parquet(sink).count() == 2     # nothing new: nothing added
    spark.createDataFrame([(3, 3.0)], schema).write.parquet(f"{landing}/b")
    ingest_new_files(spark, landing, sink, ckpt, schema)
    assert spark.read.parquet(sink).count() == 3


def test_refresh_once_writes_consistent_artifacts(spark, tmp_dir):
    from tributary.sources import fixtures as fx
    from tributary.streaming.refresh import read_artifact, refresh_once

    root = "/root/testdata/sf0.001"
    src, dst = fx.catalog_src(spark, root), fx.catalog_dst(spark, root)
    paths = refresh_once(src, dst, tmp_dir, 28, 24, 18)
    kept = cat.keep_recent_days(src, 28)
    assert read_artifact(spark, paths, "retained").count() == kept.count()
    diff = read_artifact(spark, paths, "diff")
    want = cat.catalog_diff(kept.select("path"), dst)
    assert sorted(map(tuple, diff.select("action", "path").collect())) == \
        sorted(map(tuple, want.select("action", "path").collect()))
    manifest = read_artifact(spark, paths, "manifest")
    assert manifest.count() == kept.count()
    missing = read_artifact(spark, paths, "missing")
    assert missing.count() == cat.missing_files(cat.expected_files(kept, 24, 18), kept).count()
