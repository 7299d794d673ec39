"""One run of the hourly catalog refresh, as one Spark job (I1-I5 together).

The reference runs it as separate pods joined by text-file artifacts: list
and diff, create and delete in parallel, then rebuild the combined index.
Here each step is a DataFrame over the catalogs, and each artifact is a table
of one version below the output folder (in the shared checkpoint folder on a
cluster), published when all four are written (:mod:`..sources.versions`):
readers never see artifacts of two runs, and of two runs at a time one is
refused:

* ``retained`` - source files kept by the retention window (I2);
* ``diff`` - files to index (``create``) and stale index files (``delete``),
  folder per action (J11, I3);
* ``missing`` - expected files absent from the source, reported and skipped (I5);
* ``manifest`` - ``(reference_time, time, lead, path)`` of the retained files,
  rebuilt on every run (I4).

The ingest of new data itself is :func:`.incremental.ingest_new_files` (I1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import catalog as cat
from ..sources import versions as vs

ARTIFACTS = ("retained", "diff", "missing", "manifest")
DIFF_SCHEMA = "path string, action string"


def refresh_once(source: DataFrame, index: DataFrame, out: str, keep_days: int,
                 cycles: int, leads: int) -> dict[str, str]:
    """Write and publish the four artifacts of one refresh; return their paths.

    A run that fails leaves the version before it published.  A run that ends
    after another one that started from the same version raises
    :class:`~..sources.versions.VersionTaken`.
    """
    spark = source.sparkSession
    retained = cat.keep_recent_days(source.select("path"), keep_days)
    with vs.publish(spark, out) as folder:
        paths = _paths(folder)
        retained.write.parquet(paths["retained"])
        kept = spark.read.parquet(paths["retained"])  # each later step reads the artifact
        cat.catalog_diff(kept.select("path"), index.select("path")).write.partitionBy("action").parquet(paths["diff"])
        expected = cat.expected_files(kept, cycles, leads)
        cat.missing_files(expected, kept).write.parquet(paths["missing"])
        cat.manifest(kept).write.parquet(paths["manifest"])
    return paths


def _paths(folder: str) -> dict[str, str]:
    return {name: f"{folder}/{name}" for name in ARTIFACTS}


def published(spark: SparkSession, out: str) -> dict[str, str]:
    """Paths of the artifacts of the published version below ``out``."""
    folder = vs.current(spark, out)
    if folder is None:
        raise FileNotFoundError(f"no refresh has been published below {out}")
    return _paths(folder)


def read_artifact(spark: SparkSession, paths: dict[str, str], name: str) -> DataFrame:
    # a diff without rows has no action folder, so no file to take its schema from
    return (spark.read.schema(DIFF_SCHEMA) if name == "diff" else spark.read).parquet(paths[name])
