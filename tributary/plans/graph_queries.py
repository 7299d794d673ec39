"""Named queries over hydrofabric relations and watershed id extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hydro_graph as hg
from ..session import shared_dir
from ..sources import fixtures as fx
from .common import AREA_HUC
from .registry import query

# Area-of-interest bound on divides, and the watersheds
# finished by an earlier run of the extract job.
AOI_BELOW = 5
FINISHED_HUC2 = ["01", "03"]

_SQL_LISTS = f"""(SELECT h.huc2, h.huc4, CAST(floor(r.comid / {hg.BLOCK_IDS}) AS BIGINT) AS id_block,
   list(DISTINCT r.comid ORDER BY r.comid) AS comids
 FROM reach r JOIN huc h ON r.huc_key = h.huc_key GROUP BY 1, 2, 3)"""


def _lists(spark, root):
    return hg.id_lists(hg.extract_rows(fx.reach(spark, root), fx.huc(spark, root)), ["huc2", "huc4"])


def _written_extracts(spark, root):
    path = shared_dir(spark, "huc_extracts")
    hg.write_extracts(_lists(spark, root), path)
    return hg.read_extracts(spark, path)


@query("q_flowpath_outflow", """
SELECT f.id, f.toid, f.ord, n.outflow FROM flowpaths f JOIN nexus n ON f.toid = n.id""")
def q_flowpath_outflow(spark, root):
    return hg.flowpath_outflow(fx.flowpaths(spark, root), fx.nexus(spark, root))


@query("q_crosswalk", f"""
SELECT d.toid, d.aoi, f.id, f.ord, c.comid, c.part FROM divides d JOIN flowpaths f ON d.toid = f.toid
JOIN crosswalk c ON f.id = c.id WHERE d.aoi < {AOI_BELOW}""")
def q_crosswalk(spark, root):
    d = fx.divides(spark, root).where(F.col("aoi") < AOI_BELOW)
    return hg.divide_crosswalk(d, fx.flowpaths(spark, root), fx.crosswalk(spark, root))


@query("q_huc_extract", f"""
SELECT huc4, id_block, to_json(comids) AS comids FROM {_SQL_LISTS}""")
def q_huc_extract(spark, root):
    ex = _written_extracts(spark, root)
    f = ex.select("huc4", "id_block", F.explode("features").alias("f"))
    return f.select("huc4", "id_block", F.to_json("f.properties.comids").alias("comids"))


@query("q_ids_json", f"""
SELECT huc2, huc4, id_block, to_json({{'comids': comids}}) AS comids_json FROM {_SQL_LISTS}""")
def q_ids_json(spark, root):
    return hg.ids_json(_lists(spark, root), ["huc2", "huc4"])


@query("q_huc_ids_from_json", """
SELECT h.huc4, r.comid FROM reach r JOIN huc h ON r.huc_key = h.huc_key""")
def q_huc_ids_from_json(spark, root):
    return hg.ids_from_extracts(_written_extracts(spark, root)).select("huc4", "comid")


@query("q_huc2_ids", f"""
SELECT r.comid FROM reach r JOIN huc h ON r.huc_key = h.huc_key WHERE h.huc2 = '{AREA_HUC}' ORDER BY r.comid""")
def q_huc2_ids(spark, root):
    ex = _written_extracts(spark, root).where(F.col("huc2") == AREA_HUC)  # partition pruning
    return hg.ids_from_extracts(ex).select("comid").orderBy("comid")


@query("q_resume_missing", f"""
SELECT huc4 FROM huc WHERE huc2 NOT IN ({", ".join(f"'{h}'" for h in FINISHED_HUC2)})""")
def q_resume_missing(spark, root):
    path = shared_dir(spark, "huc_resume")
    lists = _lists(spark, root)
    hg.write_extracts(lists.where(F.col("huc2").isin(FINISHED_HUC2)), path)  # the earlier, partial run
    done = hg.read_extracts(spark, path).select("huc4").distinct()
    # The to-do list is pinned (reliable checkpoint in spark.checkpoint.dir)
    # before the resumed run appends to the folder it was computed from.
    todo = fx.huc(spark, root).select("huc4").join(done, "huc4", "left_anti").checkpoint(eager=True)
    hg.write_extracts(lists.join(todo, "huc4", "left_semi"), path, mode="append")
    return todo
