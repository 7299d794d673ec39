"""Named queries: incremental ingest of forecast files, spreads kept up as they arrive."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import forecast as fo
from ..session import shared_dir
from ..sources import fixtures as fx
from ..streaming import moments as mo
from ..streaming.incremental import ingest_new_files
from .common import rounded
from .registry import query

# Fixed value: files of reference times before this date arrive in the
# first delivery, the rest in the second.
FIRST_DELIVERY_BEFORE = "1998-01-01"
SCHEMA = "feature_id long, reference_time timestamp_ntz, time timestamp_ntz, streamflow double"


@query("q_incremental_ingest", """
SELECT feature_id, reference_time, time, round(streamflow, 6) AS streamflow,
       CAST((year(time) - year(reference_time)) * 12 + month(time) - month(reference_time) AS INTEGER) AS lead
FROM forecast""")
def q_incremental_ingest(spark, root):
    base = shared_dir(spark, "ingest")
    landing, sink, ckpt = f"{base}/landing", f"{base}/sink", f"{base}/checkpoint"
    fc = fx.forecast(spark, root).select("feature_id", "reference_time", "time", "streamflow")
    early = F.col("reference_time") < F.lit(FIRST_DELIVERY_BEFORE).cast("timestamp_ntz")
    run = lambda: ingest_new_files(spark, landing, sink, ckpt, SCHEMA, fo.with_lead)
    fc.where(early).write.mode("append").parquet(f"{landing}/delivery=1")
    run()                                   # first hour: first delivery
    fc.where(~early).write.mode("append").parquet(f"{landing}/delivery=2")
    run()                                   # next hour: only the new files
    run()                                   # nothing new: adds no rows
    return rounded(spark.read.parquet(sink).select("feature_id", "reference_time", "time", "streamflow", "lead"))


# Reference times at which the second and the third delivery begin.
DELIVERIES = ("1994-01-01", "1996-01-01")


def _kept_up(spark, root, keys: list[str], axis: str):
    """Moments of the forecast cube after three deliveries, each merged by a run of its own."""
    base = shared_dir(spark, "moments")
    landing, state = f"{base}/landing", f"{base}/state"
    fc = fx.forecast(spark, root).select("feature_id", "reference_time", "time", "streamflow")
    bounds = [F.lit(d).cast("timestamp_ntz") for d in DELIVERIES]
    ref = F.col("reference_time")
    for i, rows in enumerate((ref < bounds[0], (ref >= bounds[0]) & (ref < bounds[1]), ref >= bounds[1])):
        fc.where(rows).write.mode("append").parquet(f"{landing}/delivery={i}")
        mo.keep_up(spark, landing, state, SCHEMA, keys, axis, "streamflow", span="yyyy")
    return mo.read_moments(spark, state, StructType([f for f in fc.schema.fields if f.name in keys]))


@query("q_spread_upkeep", """
SELECT feature_id, time, round(stddev_pop(streamflow), 6) AS spread, count(streamflow) AS n
FROM forecast GROUP BY 1, 2""")
def q_spread_upkeep(spark, root):
    """Spread per valid time (A8) from the state that deliveries keep up."""
    state = _kept_up(spark, root, ["feature_id", "time"], "time")
    return rounded(state.select("feature_id", "time", mo.spread(state).alias("spread"), "n"))


@query("q_deviation_upkeep", """
SELECT feature_id, round(avg(spread), 6) AS avg_deviation
FROM (SELECT feature_id, reference_time, stddev_pop(streamflow) AS spread FROM forecast GROUP BY 1, 2)
GROUP BY 1""")
def q_deviation_upkeep(spark, root):
    """Mean spread over reference times (A10) from the state that deliveries keep up."""
    state = _kept_up(spark, root, ["feature_id", "reference_time"], "reference_time")
    per_ref = state.select("feature_id", mo.spread(state).alias("spread"))
    return rounded(per_ref.groupBy("feature_id").agg(F.avg("spread").alias("avg_deviation")))
