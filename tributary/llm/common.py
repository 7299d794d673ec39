"""Shared pieces: the word pattern, the documents table, tables written to
the shared folder, and typed empty inputs."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.tables import scan

# Words and gaps as the contracts define them (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"

# Bytes and rows of one Arrow batch handed to a Python worker.
BATCH_ROWS = 4000
BATCH_BYTES = 32 * 1024 * 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "documents")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and by bytes (long texts)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: later jobs read the finished table, whatever executor
    is lost, and values that depend on the task layout stay as they are.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"llm/{name}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str = "text"):
    """Text with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def fold_crc(modulus: int):
    """``crc32(doc_id as text) mod modulus``; null ids give null."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker process.

    Functions of this package are shipped by value, so their module globals
    are new in every task; a registered module object is not.  It only holds
    caches that can be rebuilt at any time; those of other operators are
    dropped, so that a worker holds one operator's caches.
    """
    key = "_tributary_worker"
    if key not in sys.modules:
        sys.modules[key] = types.ModuleType(key)
        sys.modules[key].stores = {}
    stores = sys.modules[key].stores
    for other in [k for k in stores if k != name]:
        del stores[other]
    return stores.setdefault(name, {})


def drop_caches() -> None:
    """Empty this worker of every operator's caches and give free memory back.

    Spark reuses Python workers for the next query of a session, so a step
    without caches of its own would work beside those of the step before.
    """
    worker_store("")
    give_back()


def alone(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``step`` of mapInArrow for a worker that holds nothing else before it
    and no freed memory after it: idle workers stay beside the JVM's stages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        yield from step(batches)
        give_back()
    return run


def give_back() -> None:
    """Return freed memory to the system: Arrow's, and that of the C library
    (glibc holds on to it otherwise)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null; the keys come from ``left``.

    The right keys are renamed first, so both sides may come from one table.
    """
    right = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"{k}__r"))
        on = same if on is None else on & same
    return left.join(right, on, how).drop(*[f"{k}__r" for k in keys])


def tagged(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row number, and that column's name (one that no column
    of ``docs`` has).  Decisions on rows refer to it, so null and repeated ids
    are safe.

    Rows of a Parquet table are named by a hash of file and position, the same
    whenever and however they are read; other rows are written once.
    """
    name = "row_number"
    while name in docs.columns:
        name += "_"
    try:
        return docs.withColumn(name, F.xxhash64("_metadata.file_path", "_metadata.row_index")), name
    except AnalysisException:       # not read from files
        return written(docs.withColumn(name, F.monotonically_increasing_id()), "tagged"), name


def row_id(row: str | None):
    """The row number column of :func:`tagged`, or a new number."""
    return (F.col(row) if row else F.monotonically_increasing_id()).alias("row")
