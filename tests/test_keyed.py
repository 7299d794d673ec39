"""Keyed stores: buckets read, joins without an exchange."""

from tributary.session import shared_dir
from tributary.sources.keyed import by_key, by_keys, join_keyed, write_keyed


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_buckets_and_join(spark):
    a = spark.range(2000).selectExpr("id % 97 as k", "id as x").unionByName(spark.range(3).selectExpr("cast(null as long) as k", "-id as x"))
    b = spark.range(97).selectExpr("id as k", "id * 2 as y")
    left = write_keyed(a, "keyed_a", shared_dir(spark, "keyed/a"), "k", 8)
    right = write_keyed(b, "keyed_b", shared_dir(spark, "keyed/b"), "k", 8)
    one, some = by_key(spark, "keyed_a", "k", 5), by_keys(spark, "keyed_a", "k", [1, 2])
    assert one.count() == a.where("k = 5").count() and some.count() == a.where("k in (1, 2)").count()
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")     # else the plan does not name the buckets
    try:
        assert "SelectedBucketsCount: 1 out of 8" in plan(by_key(spark, "keyed_a", "k", 5))
        assert "SelectedBucketsCount: 2 out of 8" in plan(by_keys(spark, "keyed_a", "k", [1, 2])) or "SelectedBucketsCount: 1 out of 8" in plan(some)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert by_key(spark, "keyed_a", "k", 10 ** 6).count() == 0
    both = join_keyed(left, right, "k")
    assert "Exchange" not in plan(both) and "SortMergeJoin" in plan(both)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, a.join(b, "k").select(*both.columns).collect()))


def test_rewrite_and_empty(spark):
    path = shared_dir(spark, "keyed/c")
    write_keyed(spark.range(10).withColumnRenamed("id", "k"), "keyed_c", path, "k", 4)
    again = write_keyed(spark.range(3).withColumnRenamed("id", "k"), "keyed_c", path, "k", 4)
    assert again.count() == 3
    assert write_keyed(spark.range(0).withColumnRenamed("id", "k"), "keyed_c", path, "k", 4).count() == 0
