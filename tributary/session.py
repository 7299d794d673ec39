"""Session construction and the shared work folder.

Operators never build sessions; only tests, the bench and command-line
entry points call :func:`local_session`.  Queries that write a table read
their target folder from :func:`shared_dir`, which is rooted in the folder the
cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings every session of ours wants, whatever the cluster size.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "tributary") -> SparkSession:
    """A local session for tests and the bench (never used by operators).  It
    names a checkpoint folder only where the Spark defaults name none."""
    parts = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.driver.memory", os.environ.get("TRIBUTARY_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    for k, v in SQL_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = with_checkpoint_dir(builder)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def with_checkpoint_dir(builder: SparkSession.Builder) -> SparkSession.Builder:
    """For local sessions: name a checkpoint folder at build time unless the
    Spark defaults already do."""
    import tempfile

    from pyspark import SparkConf
    if SparkConf().get("spark.checkpoint.dir"):
        return builder
    return builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tributary-local-"))


def apply_defaults(spark: SparkSession) -> None:
    """Set the SQL settings the operators rely on (UTC clock, AQE)."""
    for k, v in SQL_DEFAULTS.items():
        spark.conf.set(k, v)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    It is only read: a folder of one machine would not be seen by the others,
    so an unset session is told what to set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share "
                           "when the session is built (.config('spark.checkpoint.dir', ...)); written tables go there")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint root for one written table."""
    return f"{checkpoint_root(spark)}/tributary/{name}/{uuid.uuid4().hex}"
