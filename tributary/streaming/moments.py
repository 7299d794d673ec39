"""Spreads that are kept up as forecasts arrive (I1 with A8-A10).

The state is a table of mergeable moments: ``n``, ``mean`` and ``m2`` (sum of
squared deviations) per key.  A delivery's moments and the state's are merged
by the pairwise update of means and squared deviations, which subtracts no
large sums, so a spread after any number of deliveries is the spread of all
rows at once.

The state is cut in spans of its time axis (a date pattern).  A batch reads and
rewrites only the spans its rows fall in; spans of the past are not touched.
``state/batch=<id>/span=<label>`` holds a span as of a batch, and the newest
committed batch of a span is its state.  Each batch ends with a commit marker
of its id (:mod:`..sources.versions`):

* a batch that is replayed after its commit changes nothing;
* one that failed before its commit is written again from the state before it;
* readers see the state as of the last committed batch.

Missing values (null, NaN) do not count; a key that has only missing values
has ``n = 0`` and a null spread, as in the full computation.  Null keys are
keys like any other; rows whose axis is null make up a span of their own.  An
empty delivery leaves the state as it is.  The key columns are named by the
caller; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import missing_as_null
from ..sources import versions as vs

NO_SPAN = "none"


def moments(rows: DataFrame, keys: list[str], var: str) -> DataFrame:
    """``n``, ``mean``, ``m2`` of ``var`` per key."""
    x = missing_as_null(var)
    n = F.count(x)
    return rows.groupBy(*keys).agg(n.alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * n).alias("m2"))


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of two sets of rows from the moments of each (one row a key and side)."""
    a, b = old.alias("a"), new.alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    # A side that lacks the key has no n; a key itself may be null.
    side = lambda k: F.when(F.col("a.n").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}"))
    na, nb = (F.coalesce(F.col(f"{s}.n"), F.lit(0)) for s in "ab")
    mean = lambda s: F.coalesce(F.col(f"{s}.mean"), F.lit(0.0))
    m2 = lambda s: F.coalesce(F.col(f"{s}.m2"), F.lit(0.0))
    n, delta = na + nb, mean("b") - mean("a")
    some = n > 0
    return a.join(b, same, "full_outer").select(
        *[side(k).alias(k) for k in keys], n.alias("n"),
        F.when(some, mean("a") + delta * nb / n).alias("mean"),
        F.when(some, m2("a") + m2("b") + delta * delta * na * nb / n).alias("m2"))


def spread(state: DataFrame) -> Column:
    """Population standard deviation of a row of moments."""
    return F.sqrt(state["m2"] / F.when(state["n"] > 0, state["n"]))


def _schema(moment: StructType) -> StructType:
    return StructType(list(moment.fields)).add("batch", "long").add("span", "string")


def _state(spark: SparkSession, root: str, schema: StructType, below: int) -> DataFrame:
    """Newest rows of every span from committed batches below a batch id."""
    done = next((n for n in vs.numbers(spark, root) if n < below and vs.marker_text(spark, root, n) == "rows"), None)
    if done is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{root}/state").where(F.col("batch") <= done)
    last = rows.groupBy("span").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["span", "batch"], "left_semi")


def merge_batch(batch: DataFrame, batch_id: int, root: str, keys: list[str], axis: str, var: str,
                span: str = "yyyy-MM-dd") -> None:
    """Merge one delivery into the state below ``root``; ``axis`` is one of ``keys``."""
    spark = batch.sparkSession
    if vs.marker_text(spark, root, batch_id) is not None:
        return
    label = F.coalesce(F.date_format(axis, span), F.lit(NO_SPAN))
    delta_path = f"{root}/delta/batch={batch_id}"
    made = moments(batch, keys, var)
    made.withColumn("span", label).write.mode("overwrite").parquet(delta_path)
    delta = spark.read.parquet(delta_path)
    if delta.isEmpty():
        vs.commit(spark, root, batch_id, "empty")
        return
    old = _state(spark, root, _schema(made.schema), batch_id)
    old = old.join(delta.select("span").distinct(), "span", "left_semi")
    (merge(old, delta, keys).withColumn("span", label)
        .write.option("partitionOverwriteMode", "static").mode("overwrite")
        .partitionBy("span").parquet(f"{root}/state/batch={batch_id}"))
    vs.commit(spark, root, batch_id, "rows")


def read_moments(spark: SparkSession, root: str, key_schema: StructType) -> DataFrame:
    """The state: key columns, ``n``, ``mean``, ``m2``, as of the last committed batch."""
    moment = StructType(list(key_schema.fields)).add("n", "long").add("mean", "double").add("m2", "double")
    last = vs.numbers(spark, root)
    return _state(spark, root, _schema(moment), (last[0] if last else 0) + 1).select(moment.fieldNames())


def keep_up(spark: SparkSession, landing: str, root: str, schema: StructType | str, keys: list[str], axis: str,
            var: str, span: str = "yyyy-MM-dd") -> None:
    """One run: merge every file of ``landing`` not yet merged, then stop.

    The stream's checkpoint lies beside the state, as the batch ids of both
    belong together.
    """
    root = root.rstrip("/")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(landing)
    q = (stream.writeStream.foreachBatch(lambda df, k: merge_batch(df, k, root, keys, axis, var, span))
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    try:
        q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()


def remove_superseded(spark: SparkSession, root: str, key_schema: StructType) -> int:
    """Delete spans that a later committed batch has rewritten; how many went.
    Not while readers of an earlier state run."""
    found = vs.newest(spark, root)
    if found is None:
        return 0
    moment = StructType(list(key_schema.fields)).add("n", "long").add("mean", "double").add("m2", "double")
    have = (spark.read.schema(_schema(moment)).parquet(f"{root}/state").where(F.col("batch") <= found[0])
            .groupBy("span").agg(F.sort_array(F.collect_set("batch"), asc=False).alias("batches")))
    old = have.select("span", F.explode(F.slice("batches", F.lit(2), F.greatest(F.size("batches") - 1, F.lit(0)))).alias("batch"))
    gone = 0
    for row in old.toLocalIterator():  # one row a folder
        vs.remove_folder(spark, f"{root}/state/batch={row.batch}/span={row.span}")
        gone += 1
    return gone
