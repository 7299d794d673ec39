"""File-catalog operators: diff, retention, manifest, expected and missing files.

A catalog is a DataFrame with a ``path`` column (object keys).  Every
operator is a set of joins and aggregates over catalogs, so listing size
does not matter: the diff is one full outer join, retention a one-row maximum
attached by broadcast, and the expected-file grid a bounded explode per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import folder_date, forecast_path, parse_forecast_path, path_key
from .joins import with_scalars


def catalog_diff(source: DataFrame, destination: DataFrame) -> DataFrame:
    """``(action, path)``: source files with no index yet (``create``) and
    index files whose source is gone (``delete``) (J11, I3).

    One full outer join on the key: each catalog is read once and its key
    computed once; rows without a partner are the difference.
    """
    # Entries without a path are not files.
    src, dst = [df.where(F.col("path").isNotNull()).select(F.col("path").alias(name), path_key("path").alias("key"))
                for df, name in ((source, "_src"), (destination, "_dst"))]
    both = src.join(dst, "key", "full_outer").where(F.col("_src").isNull() | F.col("_dst").isNull())
    return both.select(F.when(F.col("_dst").isNull(), "create").otherwise("delete").alias("action"),
                       F.coalesce("_src", "_dst").alias("path"))


def keep_recent_days(catalog: DataFrame, n_days: int) -> DataFrame:
    """Files whose folder date is at least the newest folder date minus
    ``n_days`` (closed end, so n+1 calendar days are kept) (I2, A26, O3)."""
    dated = catalog.withColumn("folder_date", folder_date("path"))
    newest = dated.agg(F.max("folder_date").alias("_newest"))
    kept = with_scalars(dated, newest).where(F.col("folder_date") >= F.date_sub("_newest", n_days))
    return kept.drop("_newest")


def manifest(catalog: DataFrame) -> DataFrame:
    """``(reference_time, time, lead, path)`` of every forecast file (I4)."""
    p = parse_forecast_path("path")
    return catalog.select(p["reference_time"].alias("reference_time"), p["valid_time"].alias("time"),
                          p["lead"].alias("lead"), "path")


def expected_files(days: DataFrame, cycles: int, leads: int, day_col: str = "folder_date") -> DataFrame:
    """Every file a day should hold: cycles x leads per day.

    Two ``explode(sequence)`` per row - bounded by ``cycles * leads`` - instead
    of a join.
    """
    grid = (days.select(day_col).distinct()
                .withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
                .withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(leads)))))
    return grid.withColumn("path", forecast_path(day_col, "cycle", "lead"))


def missing_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected files absent from the catalog: reported, then skipped."""
    return expected.join(present.select("path"), "path", "left_anti")


def list_by_name(catalog: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Catalog entries whose key starts with ``prefix`` and ends with ``suffix``."""
    return catalog.where(F.col("path").startswith(prefix) & F.col("path").endswith(suffix))
