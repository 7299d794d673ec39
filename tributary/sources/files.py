"""File-level sources and sinks: stacked files, object listings, JSON, CSV.

Labels that live in file names (a forecast's reference time, a watershed
code) are read from ``_metadata.file_path`` so that a folder of many files
reads as one table with the label as a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_by_label(df: DataFrame, path: str, label: str, mode: str = "overwrite",
                   order_cols: list[str] | None = None) -> None:
    """One folder of files per value of ``label`` (``<label>=<value>``), label column not stored in the files.

    Range-partitioned on the label (then ``order_cols``), so a large label
    value is spread over several tasks and files.
    """
    keys = [label, *(order_cols or [])]
    (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
       .write.option("partitionOverwriteMode", "static").mode(mode).partitionBy(label).parquet(path))


def read_stacked(spark: SparkSession, path: str, pattern: str, name: str,
                 fmt: str | None = None, schema: StructType | None = None) -> DataFrame:
    """Read every Parquet file below ``path`` as one table (S3).

    Partition discovery is off; the first group of ``pattern`` applied to
    each file's path becomes column ``name`` (parsed with ``fmt`` as a
    TIMESTAMP_NTZ when given), and ``path`` keeps the file name.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    fp = F.col("_metadata.file_path")
    raw = F.regexp_extract(fp, pattern, 1)
    # A file whose path lacks the label gets NULL, not a parse error.
    label = F.when(raw != "", F.to_timestamp_ntz(raw, F.lit(fmt))) if fmt else raw
    return df.select("*", label.alias(name), fp.alias("path"))


def read_stacked_first(spark: SparkSession, path: str, pattern: str, name: str, key: str, static: list[str],
                       fmt: str | None = None, schema: StructType | None = None) -> DataFrame:
    """Stacked files whose ``static`` columns come from the first file alone (S3).

    Measured columns are stacked as by :func:`read_stacked`.  The first file
    is the one with the least label (all its parts, if it is a folder); its
    static values are joined by ``key``, so files that disagree on a
    coordinate give the first file's.  Where that file has a key more than
    once, the least values count.  Keys it lacks, and null keys, have null
    coordinates; files without the label are never the first.
    """
    label = F.regexp_extract("path", pattern, 1)
    first = list_objects(spark, path, suffix=".parquet").select(label.alias("label")).where("label != ''").agg(F.min("label")).first()[0]
    of_first = read_stacked(spark, path, pattern, "_label", schema=schema).where(F.col("_label") == F.lit(first))
    coords = of_first.groupBy(key).agg(F.min(F.struct(*static)).alias("_static")).select(key, "_static.*")
    return read_stacked(spark, path, pattern, name, fmt, schema).drop(*static).join(coords, key, "left")


def list_objects(spark: SparkSession, root: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """Object listing ``(path, length, modificationTime)`` filtered by name prefix and suffix.

    File contents are never read: only listing columns are selected, which
    the binary-file source serves from file status alone.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", f"{prefix}*{suffix}").load(root))
    return df.select("path", "length", "modificationTime")


def write_csv(df: DataFrame, path: str) -> None:
    """Results as CSV with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with header and an explicit schema (no inference pass)."""
    return spark.read.option("header", "true").schema(schema).csv(path)
