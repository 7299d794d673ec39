"""Named queries: keyed reads, typed projection, first rows, batch maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators.layout import SEGMENT_FEATURES, with_segments
from ..operators.udf import map_batches
from ..sources import fixtures as fx
from ..session import shared_dir
from ..sources.keyed import by_keys, join_keyed, write_keyed
from ..sources.typed import typed_projection
from .common import rounded
from .registry import query

# The key looked up, the cast map of the typed read, and the
# number of first rows shown.
LOOKUP_HUC_KEY = 7
CASTS = {"integer": "bigint", "float": "double"}
FIRST_ROWS = 10
LOOKUP_REACHES = [3, 42, 77, 150]
BUCKETS = 16


@query("q_lookup_by_key", f"SELECT comid, huc_key FROM reach WHERE huc_key = {LOOKUP_HUC_KEY}")
def q_lookup_by_key(spark, root):
    return fx.reach(spark, root).where(F.col("huc_key") == LOOKUP_HUC_KEY)


def _store(spark, df, name, key):
    """The table written as a keyed store of its own name."""
    path = shared_dir(spark, f"keyed/{name}")
    return write_keyed(df, f"{name}_{path.rpartition('/')[2][:12]}", path, key, BUCKETS)


@query("q_keyed_lookup", f"""
SELECT comid, huc_key FROM reach WHERE comid IN ({", ".join(map(str, LOOKUP_REACHES))})""")
def q_keyed_lookup(spark, root):
    """Reaches read by a list of ids from a keyed store: the ids' buckets only."""
    store = _store(spark, fx.reach(spark, root), "reach", "comid")
    return store.where(F.col("comid").isin(LOOKUP_REACHES))


@query("q_keyed_join", """
SELECT c.comid, c.id, c.part, r.huc_key FROM crosswalk c JOIN reach r ON c.comid = r.comid""")
def q_keyed_join(spark, root):
    """Crosswalk rows with their reach: two keyed stores merged without a shuffle."""
    reach = _store(spark, fx.reach(spark, root), "reach", "comid")
    return join_keyed(_store(spark, fx.crosswalk(spark, root), "crosswalk", "comid"), reach, "comid").select("comid", "id", "part", "huc_key")


@query("q_typed_projection", """
SELECT CAST(id AS BIGINT) AS id, CAST(toid AS BIGINT) AS toid, CAST(ord AS BIGINT) AS ord FROM flowpaths""")
def q_typed_projection(spark, root):
    return typed_projection(fx.flowpaths(spark, root), CASTS)


@query("q_first_rows", f"SELECT comid, huc_key FROM reach ORDER BY comid LIMIT {FIRST_ROWS}")
def q_first_rows(spark, root):
    return fx.reach(spark, root).orderBy("comid").limit(FIRST_ROWS)


# A rating curve, stage over flow; linear between its points, level beyond.
RATING_FLOW = [0.0, 5.0, 15.0, 30.0, 50.0]
RATING_STAGE = [0.0, 1.2, 2.1, 2.9, 3.5]


def _stage(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf[["feature_id", "time", "segment"]].copy()
    out["stage"] = np.interp(pdf["streamflow"], RATING_FLOW, RATING_STAGE)
    return out


_SQL_STAGE = "CASE " + " ".join(
    f"WHEN streamflow <= {x1!r} THEN {y0!r} + (streamflow - {x0!r}) * {(y1 - y0) / (x1 - x0)!r}"
    for x0, x1, y0, y1 in zip(RATING_FLOW, RATING_FLOW[1:], RATING_STAGE, RATING_STAGE[1:])) + f" ELSE {RATING_STAGE[-1]!r} END"


@query("q_map_segments", f"""
WITH pf AS (SELECT feature_id, dense_rank() OVER (ORDER BY feature_id) - 1 AS p FROM (SELECT DISTINCT feature_id FROM flow))
SELECT f.feature_id, f.time, CAST(floor(pf.p / {SEGMENT_FEATURES}) AS INTEGER) AS segment,
       round({_SQL_STAGE}, 6) AS stage
FROM flow f JOIN pf USING (feature_id)""")
def q_map_segments(spark, root):
    seg = with_segments(fx.flow(spark, root))
    out = map_batches(seg, _stage, "feature_id long, time timestamp_ntz, segment int, stage double")
    return rounded(out)
