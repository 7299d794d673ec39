"""Keyed tables: rows dealt to buckets by their key and sorted within them.

A read by key opens one bucket, a read by a list of keys the buckets of the
list, and two tables with the same buckets join without an exchange.  The
tables are external ones of the session's catalog, at a path of the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_keyed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` bucketed and sorted by ``key``; an earlier table of this
    name is replaced.  Every task holds the rows of some buckets, so a bucket
    is one file and its sort order can be used."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)
    return spark.table(table)


def by_key(spark: SparkSession, table: str, key: str, value) -> DataFrame:
    """The rows of one key; only its bucket is read."""
    return spark.table(table).where(F.col(key) == F.lit(value))


def by_keys(spark: SparkSession, table: str, key: str, values: list) -> DataFrame:
    """The rows of a short list of keys; only their buckets are read."""
    return spark.table(table).where(F.col(key).isin(values))


def join_keyed(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join of two keyed tables of equal buckets: a merge of sorted files, so
    neither side is shuffled, however large."""
    return left.hint("merge").join(right, key)
