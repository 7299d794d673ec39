"""Incremental ingest of forecast files.

The hourly job of the reference - find new files, ingest only those, never
two runs at once - is a Structured Streaming query over a file source run
with ``trigger(availableNow=True)``:

* the checkpoint's source log is the set of files already ingested, so each
  run reads only files that arrived since the last one;
* the file sink commits each batch to ``_spark_metadata``, so readers see
  whole batches only and a rerun after a failure does not duplicate rows;
* two runs on one checkpoint cannot commit the same batch - the second
  fails instead of ingesting twice.

Each run processes what is there and stops, so it fits a scheduler.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def ingest_new_files(spark: SparkSession, landing: str, sink: str, checkpoint: str, schema: StructType | str,
                     transform: Callable[[DataFrame], DataFrame] | None = None,
                     max_files_per_trigger: int | None = None, partition_by: list[str] | None = None) -> None:
    """One run: ingest every Parquet file in ``landing`` not yet ingested, then stop."""
    # Deliveries may land in sub-folders of any name.
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.parquet(landing)
    if transform is not None:
        stream = transform(stream)
    writer = (stream.writeStream.format("parquet").option("path", sink)
              .option("checkpointLocation", checkpoint).outputMode("append")
              .trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    q = writer.start()
    try:
        q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()
    if q.exception() is not None:
        raise RuntimeError(f"ingest failed: {q.exception()}")
