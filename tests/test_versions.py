"""Published versions, the refresh on top of them, and moments kept up by deliveries."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from tributary.operators import catalog as cat
from tributary.sources import versions as vs
from tributary.streaming import moments as mo
from tributary.streaming.refresh import published, read_artifact, refresh_once

SCHEMA = "k string, t timestamp_ntz, v double, n long"


def test_readers_see_whole_versions(spark, tmp_dir):
    assert vs.current(spark, tmp_dir) is None
    with vs.publish(spark, tmp_dir) as first:
        spark.range(3).write.parquet(f"{first}/a")
        assert vs.current(spark, tmp_dir) is None
    assert vs.current(spark, tmp_dir) == first
    with pytest.raises(ZeroDivisionError), vs.publish(spark, tmp_dir) as failed:
        spark.range(9).write.parquet(f"{failed}/a")
        1 / 0
    assert vs.current(spark, tmp_dir) == first
    with vs.publish(spark, tmp_dir) as third:
        spark.range(5).write.parquet(f"{third}/a")
    assert spark.read.parquet(vs.current(spark, tmp_dir) + "/a").count() == 5


def test_second_run_is_refused(spark, tmp_dir):
    with pytest.raises(vs.VersionTaken):
        with vs.publish(spark, tmp_dir) as slow:
            with vs.publish(spark, tmp_dir) as quick:
                spark.range(1).write.parquet(f"{quick}/a")
            spark.range(2).write.parquet(f"{slow}/a")
    assert vs.current(spark, tmp_dir) == quick


def test_incomplete_marker_is_passed_over(spark, tmp_dir):
    with vs.publish(spark, tmp_dir) as first:
        spark.range(1).write.parquet(f"{first}/a")
    with open(f"{tmp_dir}/_commits/{1:012d}", "w") as half:
        half.write("000000000001-ab")
    assert vs.current(spark, tmp_dir) == first
    with vs.publish(spark, tmp_dir) as later:
        spark.range(2).write.parquet(f"{later}/a")
    assert vs.current(spark, tmp_dir) == later and "/000000000002-" in later


def test_remove_old_keeps_published_and_running(spark, tmp_dir):
    folders = []
    for n in range(3):
        with vs.publish(spark, tmp_dir) as folder:
            spark.range(n).write.parquet(f"{folder}/a")
        folders.append(folder)
    with vs.publish(spark, tmp_dir) as running:
        spark.range(7).write.parquet(f"{running}/a")
        assert vs.remove_old(spark, tmp_dir, keep=2) == [folders[0].rsplit("/", 1)[1]]
    assert spark.read.parquet(vs.current(spark, tmp_dir) + "/a").count() == 7
    assert spark.read.parquet(f"{folders[2]}/a").count() == 2
    with pytest.raises(ValueError):
        vs.remove_old(spark, tmp_dir, keep=0)


def test_refresh_without_changes_publishes_an_empty_diff(spark, tmp_dir):
    name = "nwm.20240102/short_range/nwm.t00z.short_range.channel_rt.f001.conus"
    src = spark.createDataFrame([(f"{name}.nc",)], "path string")
    index = spark.createDataFrame([(f"kerchunk/{name}.json",)], "path string")
    refresh_once(src, index, tmp_dir, 28, 24, 18)
    diff = read_artifact(spark, published(spark, tmp_dir), "diff")
    assert diff.columns == ["path", "action"] and diff.count() == 0


def test_failed_refresh_leaves_the_version_before(spark, tmp_dir, monkeypatch):
    path = "nwm.20220101/short_range/nwm.t{:02d}z.short_range.channel_rt.f001.conus.nc"
    src = spark.createDataFrame([(path.format(h),) for h in (0, 1)], "path string")
    none = src.limit(0)
    with pytest.raises(FileNotFoundError):
        published(spark, tmp_dir)
    refresh_once(src, none, tmp_dir, 28, 24, 18)
    monkeypatch.setattr(cat, "missing_files", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        refresh_once(src.limit(1), none, tmp_dir, 28, 24, 18)
    for name, rows in (("retained", 2), ("diff", 2), ("manifest", 2)):
        assert read_artifact(spark, published(spark, tmp_dir), name).count() == rows


def rows(spark, data):
    return spark.createDataFrame(data, "k string, t string, v double, n long") \
        .withColumn("t", F.col("t").cast("timestamp_ntz"))


DELIVERIES = [
    [("a", "2020-01-01 05:00:00", 1e9, 5), ("a", "2020-01-01 05:00:00", 1e9 + 1, 5), (None, "2020-01-01 06:00:00", 2.0, 5),
     ("b", None, 4.0, 5), ("c", "2020-01-03 00:00:00", None, 5)],
    [("a", "2020-01-01 05:00:00", 1e9 + 5, 5), ("a", "2020-01-02 05:00:00", 3.0, 5), (None, "2020-01-01 06:00:00", 8.0, 5),
     ("b", None, float("nan"), 5), ("c", "2020-01-03 00:00:00", float("nan"), 5)],
    [],
    [("b", None, 6.0, 5), ("a", "2020-01-01 05:00:00", 1e9 + 2, 5), ("a", "2020-01-01 05:00:00", 1e9 + 2, 5)],
]


def key_schema(spark):
    return rows(spark, []).select("k", "t").schema


def held(spark, root):
    state = mo.read_moments(spark, root, key_schema(spark))
    return {(r.k, str(r.t)): (r.n, r.spread) for r in state.select("k", "t", "n", mo.spread(state).alias("spread")).collect()}


def whole(deliveries):
    groups = {}
    for k, t, v, _ in [r for d in deliveries for r in d]:
        groups.setdefault((k, str(t)), []).extend([v] if v is not None and not math.isnan(v) else [])
    return {g: (len(v), statistics.pstdev(v) if v else None) for g, v in groups.items()}


def same(got, want):
    assert set(got) == set(want)
    for g, (n, s) in want.items():
        assert got[g][0] == n
        assert got[g][1] is None if s is None else got[g][1] == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_deliveries_equal_full_recomputation_and_replays_change_nothing(spark, tmp_dir):
    assert held(spark, tmp_dir) == {}
    for k, d in enumerate(DELIVERIES):
        mo.merge_batch(rows(spark, d), k, tmp_dir, ["k", "t"], "t", "v")
        same(held(spark, tmp_dir), whole(DELIVERIES[:k + 1]))
        mo.merge_batch(rows(spark, d), k, tmp_dir, ["k", "t"], "t", "v")      # replayed after its commit
        same(held(spark, tmp_dir), whole(DELIVERIES[:k + 1]))
    # Only the spans of a delivery are written.
    last = spark.read.parquet(f"{tmp_dir}/state/batch=3").select("span").distinct().collect()
    assert {r.span for r in last} == {"none", "2020-01-01"}
    # 2020-01-01 and none: written three times; 2020-01-03: twice; 2020-01-02: once.
    assert mo.remove_superseded(spark, tmp_dir, key_schema(spark)) == 5
    same(held(spark, tmp_dir), whole(DELIVERIES))


def test_batch_that_failed_before_its_commit_is_written_again(spark, tmp_dir, monkeypatch):
    mo.merge_batch(rows(spark, DELIVERIES[0]), 0, tmp_dir, ["k", "t"], "t", "v")
    kept = vs.commit
    monkeypatch.setattr(vs, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        mo.merge_batch(rows(spark, DELIVERIES[1]), 1, tmp_dir, ["k", "t"], "t", "v")
    same(held(spark, tmp_dir), whole(DELIVERIES[:1]))          # not seen by readers
    monkeypatch.setattr(vs, "commit", kept)
    mo.merge_batch(rows(spark, DELIVERIES[1]), 1, tmp_dir, ["k", "t"], "t", "v")
    same(held(spark, tmp_dir), whole(DELIVERIES[:2]))


def test_runs_merge_each_file_once(spark, tmp_dir):
    landing, root = f"{tmp_dir}/in", f"{tmp_dir}/state"
    for k, d in enumerate(DELIVERIES[:2]):
        rows(spark, d).write.parquet(f"{landing}/{k}")
        mo.keep_up(spark, landing, root, SCHEMA, ["k", "t"], "t", "v")
    mo.keep_up(spark, landing, root, SCHEMA, ["k", "t"], "t", "v")
    same(held(spark, root), whole(DELIVERIES[:2]))
