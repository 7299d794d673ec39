"""Hydrofabric relations and per-watershed id extracts.

The graph joins are plain equi joins; many-to-many matches on ``toid`` keep
their duplicates, as the relational chain in the reference does.

Id lists per watershed are written as JSON documents.  A watershed's list is
cut into blocks of at most ``BLOCK_IDS`` id values (``comid div BLOCK_IDS``),
so no single document, row or task has to hold an unbounded list; readers
concatenate the blocks in block order, which keeps the ids sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: width of the id range held by one extract document.
BLOCK_IDS = 1_000_000


def flowpath_outflow(flowpaths: DataFrame, nexus: DataFrame) -> DataFrame:
    """Flowpaths with the nexus they drain to."""
    n = nexus.withColumnRenamed("id", "nexus_id")
    return flowpaths.join(n, flowpaths.toid == n.nexus_id).drop("nexus_id")


def divide_crosswalk(divides: DataFrame, flowpaths: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Divides -> flowpaths (on ``toid``) -> crosswalk (on flowpath ``id``)."""
    fp = flowpaths.select("id", "toid", "ord")
    return divides.join(fp, "toid").join(crosswalk, "id")


def extract_rows(reach: DataFrame, huc: DataFrame) -> DataFrame:
    """Per-watershed extract rows: its reach ids plus one boundary row.

    The boundary row is marked by ``is_boundary`` rather than by a reserved
    id, so a real reach with id 0 is kept.
    """
    ids = reach.join(huc, "huc_key").select("huc2", "huc4", "comid", F.lit(False).alias("is_boundary"))
    boundary = huc.select("huc2", "huc4", F.lit(None).cast("long").alias("comid"), F.lit(True).alias("is_boundary"))
    return ids.unionByName(boundary)


def id_lists(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted reach-id lists per watershed and id block, boundary row dropped."""
    ids = rows.where(~F.col("is_boundary"))
    block = F.floor(F.col("comid") / BLOCK_IDS).cast("long").alias("id_block")
    return ids.groupBy(*keys, block).agg(F.sort_array(F.collect_set("comid")).alias("comids"))


EXTRACT_SCHEMA = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.StructType([
            T.StructField("huc8", T.StringType()),
            T.StructField("comids", T.ArrayType(T.LongType())),
        ])),
    ]))),
    T.StructField("id_block", T.LongType()),
    T.StructField("huc2", T.StringType()),
    T.StructField("huc4", T.StringType()),
])


def write_extracts(lists: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per watershed and id block, in ``huc2=/huc4=`` folders."""
    doc = F.array(F.struct(F.struct(F.col("huc4").alias("huc8"), F.col("comids").alias("comids"))
                           .alias("properties")))
    out = lists.select(doc.alias("features"), "id_block", "huc2", "huc4")
    (out.repartitionByRange("huc2", "huc4", "id_block").sortWithinPartitions("huc2", "huc4", "id_block")
        .write.option("partitionOverwriteMode", "static").mode(mode).partitionBy("huc2", "huc4").json(path))


def read_extracts(spark: SparkSession, path: str) -> DataFrame:
    """Extract documents with the watershed codes kept as strings (no type inference)."""
    return spark.read.schema(EXTRACT_SCHEMA).json(path)


def ids_from_extracts(extracts: DataFrame) -> DataFrame:
    """``(huc4, comid)`` from ``features[].properties.comids``."""
    f = extracts.select("huc2", "huc4", F.explode("features").alias("f"))
    return f.select("huc2", "huc4", F.explode("f.properties.comids").alias("comid"))


def ids_json(lists: DataFrame, keys: list[str]) -> DataFrame:
    """``{"comids": [...]}`` text per watershed and id block."""
    return lists.select(*keys, "id_block", F.to_json(F.struct("comids")).alias("comids_json"))
