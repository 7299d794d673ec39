"""Table layouts: the array chunking of the reference re-expressed as
partitioning, sorting and file layout of long tables.

* A *chunk* of a cube is a block of ``size_t`` consecutive time labels by
  ``size_f`` consecutive feature labels; its id is
  ``(floor(pos_t / size_t), floor(pos_f / size_f))`` where ``pos`` is the
  dense position of the label on its axis (:mod:`.ranking`).
* Writing "with chunks" clusters blocks of chunks into folders
  (``partitionBy``), sorted by chunk inside; the
  transposed layout (long time, few features) serves long series of few
  reaches, the original one short windows over many reaches.
* A sorted layout (``repartitionByRange`` + ``sortWithinPartitions``) gives
  tight Parquet row-group statistics, so point lookups skip row groups.

Writers replace their whole target (static overwrite), so a rerun leaves no
old folder behind.  Only the two-axis archive overwrites dynamically: it
replaces exactly the partitions it is given.  How many files are written
follows from the data (Spark sizes the range partitions), not from a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import join_positions

# Chunk shapes (time labels x feature labels) of the reference.
CHUNKS_ORIGINAL = (672, 30000)
CHUNKS_TRANSPOSED = (30000, 672)
CHUNKS_SQUARE = (300, 300)
SEGMENT_FEATURES = 2000  # features per write segment


# Fixed value: fine chunks per axis that share one coarse folder.
CHUNKS_PER_FOLDER = 16

STATIC = {"partitionOverwriteMode": "static"}


def clustered(df: DataFrame, partition_cols: list[str], order_cols: list[str]) -> DataFrame:
    """Range-partition on the folder keys, then the order keys, and sort.

    Each task receives one contiguous key range: a small folder value lands
    in one task (one file), a large or hot one is split across several tasks
    by the sampled range bounds instead of overloading a single task, and
    files come out sorted, so row-group statistics prune lookups.
    """
    keys = [*partition_cols, *order_cols]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def with_positions(cube: DataFrame, axes: dict[str, str]) -> DataFrame:
    """Add the dense position of each axis label: ``{axis_col: pos_col}``."""
    return join_positions(cube, axes)


def _chunk(pos: str, size: int) -> Column:
    return F.floor(F.col(pos) / size).cast("int")


def with_chunk_ids(cube: DataFrame, size_t: int, size_f: int,
                   time_col: str = "time", feature_col: str = "feature_id") -> DataFrame:
    """Add ``chunk_time`` and ``chunk_feature`` for a ``size_t x size_f``
    chunking (L1-L3).  A row whose label is null has a null chunk."""
    out = with_positions(cube, {time_col: "_pos_t", feature_col: "_pos_f"})
    return out.withColumn("chunk_time", _chunk("_pos_t", size_t)).withColumn("chunk_feature", _chunk("_pos_f", size_f)) \
        .drop("_pos_t", "_pos_f")


def write_chunked(chunked: DataFrame, path: str, sort_cols: list[str]) -> None:
    """Chunks sorted together inside coarse folders (L1-L3).

    ``CHUNKS_PER_FOLDER`` chunks per axis share a folder, so small chunks do
    not make millions of folders; the chunk ids are sorted columns, whose
    row-group statistics prune single chunks.
    """
    keys = ["chunk_time", "chunk_feature"]
    folder = {f"folder_{k[6:]}": F.floor(F.col(k) / CHUNKS_PER_FOLDER).cast("int") for k in keys}
    (clustered(chunked.withColumns(folder), list(folder), [*keys, *sort_cols])
        .write.options(**STATIC).mode("overwrite").partitionBy(*folder).parquet(path))


def read_chunked(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("folder_time", "folder_feature")


def chunk_report(chunked: DataFrame, time_col: str = "time", feature_col: str = "feature_id") -> DataFrame:
    """Per chunk: rows, time labels and feature labels it holds (L4)."""
    return (chunked.groupBy("chunk_time", "chunk_feature")
                   .agg(F.count(F.lit(1)).alias("nb_rows"),
                        F.count_distinct(time_col).alias("nb_times"),
                        F.count_distinct(feature_col).alias("nb_features")))


def chunks_touched(chunked_subset: DataFrame) -> DataFrame:
    """Number of distinct chunks a selection reads."""
    return chunked_subset.agg(F.count_distinct("chunk_time", "chunk_feature").alias("nb_chunks"))


def write_sorted(df: DataFrame, path: str, key: str) -> None:
    """Range-partitioned, sorted rewrite by ``key`` (S20, S14 second copy)."""
    clustered(df, [], [key]).write.mode("overwrite").parquet(path)


def write_monthly(cube: DataFrame, path: str, time_col: str = "time") -> None:
    """One set of files per month: ``year=/month=`` folders."""
    out = cube.withColumn("year", F.year(time_col)).withColumn("month", F.month(time_col))
    order = [c for c in ("feature_id", time_col) if c in out.columns]
    (clustered(out, ["year", "month"], order)
        .write.options(**STATIC).mode("overwrite").partitionBy("year", "month").parquet(path))


def with_segments(cube: DataFrame, size: int = SEGMENT_FEATURES, feature_col: str = "feature_id") -> DataFrame:
    """``segment = floor(pos_f / size)``: write segments of ``size`` consecutive features."""
    return with_positions(cube, {feature_col: "_pos_f"}).withColumn("segment", _chunk("_pos_f", size)).drop("_pos_f")


def write_segments(segmented: DataFrame, path: str, feature_col: str = "feature_id") -> None:
    (clustered(segmented, ["segment"], [feature_col])
        .write.options(**STATIC).mode("overwrite").partitionBy("segment").parquet(path))


def append_slices(df: DataFrame, path: str, slice_col: str, order_cols: list[str] | None = None) -> None:
    """Add slices to an archive, one folder per value of ``slice_col``.

    One write for all slices of ``df``; slices already there are replaced, the
    others stay, so a rerun leaves the same rows.
    """
    (clustered(df, [slice_col], order_cols or []).write.option("partitionOverwriteMode", "dynamic")
        .mode("overwrite").partitionBy(slice_col).parquet(path))


def write_two_axis(df: DataFrame, path: str, outer: str, inner: str, order_cols: list[str] | None = None) -> None:
    """Archive appendable on two axes: ``outer=/inner=`` folders.

    Written with dynamic partition overwrite, so rewriting a slice replaces
    exactly the partitions it holds and leaves the rest.
    """
    (clustered(df, [outer, inner], order_cols or []).write.option("partitionOverwriteMode", "dynamic")
        .mode("overwrite").partitionBy(outer, inner).parquet(path))


def cube_size(cube: DataFrame, time_col: str = "time", feature_col: str = "feature_id",
              bytes_per_cell: int = 4) -> DataFrame:
    """Labels on each axis, dense cell count and size in GB."""
    n = cube.agg(F.count_distinct(time_col).alias("nb_times"), F.count_distinct(feature_col).alias("nb_features"))
    cells = F.col("nb_times") * F.col("nb_features")
    return n.select("nb_times", "nb_features", cells.alias("nb_cells"),
                    (cells * bytes_per_cell / 1e9).alias("size_gb"))
