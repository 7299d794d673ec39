"""Analysis of timing results ``(query, nb_days, source, time, ...)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: chunk size recorded when the storage has no chunks.
UNKNOWN_CHUNK = -9999


def summarize(results: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population std and count of ``time`` per group."""
    return results.groupBy(*keys).agg(F.avg("time").alias("time_mean"), F.stddev_pop("time").alias("time_std"),
                                      F.count(F.lit(1)).alias("nb_repeats"))


def with_labels(results: DataFrame) -> DataFrame:
    """Readable copies and labels (P18, P19): ``chunk_sz = "(t, f)"``, and a
    data-format label that names the chunk shape for chunked stores."""
    chunk = F.format_string("(%d, %d)", F.col("time_chunk_sz"), F.col("feature_id_chunk_sz"))
    label = F.when(F.col("data_format") == "zarr", F.concat(F.lit("zarr "), chunk)).otherwise(F.col("data_format"))
    return (results.withColumn("chunk_sz", chunk)
                   .withColumn("chunk_shape", F.col("chunk_sz"))
                   .withColumn("run_time_secs", F.col("time"))
                   .withColumn("days_in_query", F.col("nb_days"))
                   .withColumn("data_format_label", label))


def bars(labelled: DataFrame) -> DataFrame:
    """Mean run time per ``(query, nb_days, data_format_label)`` - the bar chart's table."""
    return labelled.groupBy("query", "nb_days", "data_format_label").agg(F.avg("time").alias("time_mean"))


def ratio_of_means(df: DataFrame, cond_num, cond_den, keys: list[str] | None = None) -> DataFrame:
    """``avg(time | cond_num) / avg(time | cond_den)`` per group, one pass."""
    num = F.avg(F.when(cond_num, F.col("time")))
    den = F.avg(F.when(cond_den, F.col("time")))
    g = df.groupBy(*keys) if keys else df
    return g.agg((num / den).alias("ratio"))


def concat_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concatenate result tables, duplicates kept, missing columns as NULL."""
    return a.unionByName(b, allowMissingColumns=True)
