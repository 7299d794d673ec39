"""Scans of the Parquet tables a query starts from.

``scan`` only names the table; column pruning and filter pushdown are left
to Catalyst, which narrows ``ReadSchema`` and fills ``PushedFilters`` from
the projections and predicates the operators put on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lazy scan of ``<root>/<name>.parquet``."""
    return spark.read.parquet(table_path(root, name))
