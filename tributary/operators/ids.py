"""Reach-id resolution: ids of an area, ids present in a cube, membership.

Id sets stay DataFrames.  They enter the large side as ``left_semi`` joins;
Spark broadcasts the id side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (statically from file statistics,
or at run time through AQE), and shuffles both sides otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import with_scalars


def area_ids(reach: DataFrame, huc: DataFrame, huc_prefix: str, code_col: str = "huc4") -> DataFrame:
    """Reach ids (``comid``) of the watersheds whose code starts with ``huc_prefix``.

    A prefix of a watershed code names its parent, so this is the set of
    reaches of an area at any level (S6); where reaches come from a spatial
    join instead, :mod:`.spatial` gives the same ``comid`` set (J5).
    """
    codes = huc.where(F.col(code_col).startswith(huc_prefix)).select("huc_key")
    return reach.join(codes, "huc_key", "left_semi").select("comid")


def available_ids(ids: DataFrame, cube: DataFrame, id_col: str = "feature_id") -> DataFrame:
    """Ids of ``ids`` (column ``comid``) that exist in ``cube``."""
    present = cube.select(F.col(id_col).alias("comid"))
    return present.join(ids.select("comid").distinct(), "comid", "left_semi").distinct()


def subset_ids(cube: DataFrame, ids: DataFrame, id_col: str = "feature_id") -> DataFrame:
    """Rows of ``cube`` whose id is in ``ids``."""
    keys = ids.select(F.col("comid").alias(id_col))
    return cube.join(keys, id_col, "left_semi")


def id_counts(ids: DataFrame, available: DataFrame) -> DataFrame:
    """One row: ids in the area and ids available in the cube."""
    a = ids.agg(F.count_distinct("comid").alias("nb_area_ids"))
    b = available.agg(F.count_distinct("comid").alias("nb_available_ids"))
    return with_scalars(a, b)
