"""Named queries over table layouts: positions, chunking, partitioned writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import range_closed
from ..operators import forecast as fo
from ..operators import layout as lay
from ..operators.ids import subset_ids
from ..operators.joins import with_scalars
from ..operators.ranking import dense_positions
from ..session import shared_dir
from ..sources import fixtures as fx
from .common import POINT_FEATURE, RANGE_START, RANGE_STOP, SQL_AREA_IDS, SQL_CLOSED, rounded, study_ids
from .registry import query

# The positional slice (first labels of each axis).
SLICE_TIMES = 365
SLICE_FEATURES = 50

_SQL_POS = """pt AS (SELECT time, dense_rank() OVER (ORDER BY time) - 1 AS p FROM (SELECT DISTINCT time FROM flow)),
pf AS (SELECT feature_id, dense_rank() OVER (ORDER BY feature_id) - 1 AS p FROM (SELECT DISTINCT feature_id FROM flow))"""


def _sql_chunked(size_t, size_f, where="TRUE"):
    return f"""WITH {_SQL_POS}
SELECT f.feature_id, f.time, round(f.streamflow, 6) AS streamflow,
       CAST(floor(pt.p / {size_t}) AS INTEGER) AS chunk_time, CAST(floor(pf.p / {size_f}) AS INTEGER) AS chunk_feature
FROM flow f JOIN pt USING (time) JOIN pf USING (feature_id) WHERE {where}"""


def _chunked_copy(spark, root, shape, sort_cols, name):
    path = shared_dir(spark, name)
    lay.write_chunked(lay.with_chunk_ids(fx.flow(spark, root), *shape), path, sort_cols)
    return lay.read_chunked(spark, path)


@query("q_label_position", """
SELECT time, dense_rank() OVER (ORDER BY time) - 1 AS pos FROM (SELECT DISTINCT time FROM flow)""")
def q_label_position(spark, root):
    return dense_positions(fx.flow(spark, root), "time", "pos")


@query("q_positional_slice", f"""
WITH {_SQL_POS}
SELECT f.feature_id, f.time, round(f.streamflow, 6) AS streamflow FROM flow f JOIN pt USING (time) JOIN pf USING (feature_id)
WHERE pt.p < {SLICE_TIMES} AND pf.p < {SLICE_FEATURES}""")
def q_positional_slice(spark, root):
    flow = fx.flow(spark, root)
    pos = lay.with_positions(flow, {"time": "_pt", "feature_id": "_pf"})
    return rounded(pos.where((F.col("_pt") < SLICE_TIMES) & (F.col("_pf") < SLICE_FEATURES))
                      .select("feature_id", "time", "streamflow"))


@query("q_chunk_ids", _sql_chunked(*lay.CHUNKS_ORIGINAL))
def q_chunk_ids(spark, root):
    df = _chunked_copy(spark, root, lay.CHUNKS_ORIGINAL, ["feature_id", "time"], "chunks_original")
    return rounded(df.select("feature_id", "time", "streamflow", "chunk_time", "chunk_feature"))


@query("q_rechunk_transposed", _sql_chunked(*lay.CHUNKS_TRANSPOSED))
def q_rechunk_transposed(spark, root):
    df = _chunked_copy(spark, root, lay.CHUNKS_TRANSPOSED, ["feature_id", "time"], "chunks_transposed")
    return rounded(df.select("feature_id", "time", "streamflow", "chunk_time", "chunk_feature"))


@query("q_chunk_square", _sql_chunked(*lay.CHUNKS_SQUARE))
def q_chunk_square(spark, root):
    df = _chunked_copy(spark, root, lay.CHUNKS_SQUARE, ["time", "feature_id"], "chunks_square")
    return rounded(df.select("feature_id", "time", "streamflow", "chunk_time", "chunk_feature"))


@query("q_chunk_report", f"""
SELECT chunk_time, chunk_feature, count(*) AS nb_rows, count(DISTINCT time) AS nb_times,
       count(DISTINCT feature_id) AS nb_features
FROM ({_sql_chunked(*lay.CHUNKS_SQUARE)}) GROUP BY 1, 2""")
def q_chunk_report(spark, root):
    return lay.chunk_report(lay.with_chunk_ids(fx.flow(spark, root), *lay.CHUNKS_SQUARE))


@query("q_chunks_touched", f"""
SELECT 'original' AS layout, count(DISTINCT (chunk_time, chunk_feature)) AS nb_chunks
FROM ({_sql_chunked(*lay.CHUNKS_ORIGINAL, f"f.feature_id IN {SQL_AREA_IDS} AND f.{SQL_CLOSED}")})
UNION ALL
SELECT 'square' AS layout, count(DISTINCT (chunk_time, chunk_feature)) AS nb_chunks
FROM ({_sql_chunked(*lay.CHUNKS_SQUARE, f"f.feature_id IN {SQL_AREA_IDS} AND f.{SQL_CLOSED}")})""")
def q_chunks_touched(spark, root):
    # Positions of both axes are found once and serve both shapes.
    flow = lay.with_positions(fx.flow(spark, root), {"time": "_pt", "feature_id": "_pf"})
    sel = subset_ids(flow, study_ids(spark, root)).where(range_closed("time", RANGE_START, RANGE_STOP))
    shapes = F.array(*[F.struct(F.lit(name).alias("layout"), F.floor(F.col("_pt") / t).alias("chunk_time"),
                                F.floor(F.col("_pf") / f).alias("chunk_feature"))
                       for name, (t, f) in [("original", lay.CHUNKS_ORIGINAL), ("square", lay.CHUNKS_SQUARE)]])
    return sel.select(F.inline(shapes)).groupBy("layout").agg(
        F.count_distinct("chunk_time", "chunk_feature").alias("nb_chunks"))


@query("q_cube_size", f"""
WITH a AS (SELECT count(DISTINCT time) AS nb_times, count(DISTINCT feature_id) AS nb_features FROM flow),
b AS (SELECT count(DISTINCT time) AS nb_times, count(DISTINCT feature_id) AS nb_features FROM flow
      WHERE feature_id IN {SQL_AREA_IDS} AND {SQL_CLOSED})
SELECT a.nb_times, a.nb_features, a.nb_times * a.nb_features AS nb_cells,
       round(a.nb_times * a.nb_features * 4 / 1e9, 6) AS size_gb,
       b.nb_times AS subset_nb_times, b.nb_features AS subset_nb_features,
       b.nb_times * b.nb_features AS subset_nb_cells, round(b.nb_times * b.nb_features * 4 / 1e9, 6) AS subset_size_gb
FROM a, b""")
def q_cube_size(spark, root):
    flow = fx.flow(spark, root)
    full = lay.cube_size(flow)
    sub = subset_ids(flow, study_ids(spark, root)).where(range_closed("time", RANGE_START, RANGE_STOP))
    part = lay.cube_size(sub).select(*[F.col(c).alias(f"subset_{c}") for c in
                                      ["nb_times", "nb_features", "nb_cells", "size_gb"]])
    return rounded(with_scalars(full, part))


@query("q_month_partitioned", """
SELECT feature_id, time, round(streamflow, 6) AS streamflow, CAST(year(time) AS INTEGER) AS year,
       CAST(month(time) AS INTEGER) AS month FROM flow""")
def q_month_partitioned(spark, root):
    path = shared_dir(spark, "monthly")
    lay.write_monthly(fx.flow(spark, root), path)
    back = spark.read.parquet(path)
    return rounded(back.select("feature_id", "time", "streamflow", F.col("year").cast("int").alias("year"),
                               F.col("month").cast("int").alias("month")))


@query("q_feature_segments", f"""
WITH pf AS (SELECT feature_id, dense_rank() OVER (ORDER BY feature_id) - 1 AS p FROM (SELECT DISTINCT feature_id FROM flow))
SELECT f.feature_id, f.time, round(f.streamflow, 6) AS streamflow,
       CAST(floor(pf.p / {lay.SEGMENT_FEATURES}) AS INTEGER) AS segment
FROM flow f JOIN pf USING (feature_id)""")
def q_feature_segments(spark, root):
    path = shared_dir(spark, "segments")
    lay.write_segments(lay.with_segments(fx.flow(spark, root)), path)
    back = spark.read.parquet(path)
    return rounded(back.select("feature_id", "time", "streamflow", F.col("segment").cast("int").alias("segment")))


_SQL_LEAD = """SELECT feature_id, reference_time, time, round(streamflow, 6) AS streamflow,
       CAST((year(time) - year(reference_time)) * 12 + month(time) - month(reference_time) AS INTEGER) AS lead
FROM forecast"""

# Fixed value: the lead at which the archive is cut into two appended slices.
APPEND_SPLIT_LEAD = 6


@query("q_archive_append", _SQL_LEAD)
def q_archive_append(spark, root):
    fc = fo.with_lead(fx.forecast(spark, root))
    path = shared_dir(spark, "archive")
    for part in (fc.where(F.col("lead") <= APPEND_SPLIT_LEAD), fc.where(F.col("lead") > APPEND_SPLIT_LEAD),
                 fc.where(F.col("lead") > APPEND_SPLIT_LEAD)):      # the second delivery runs twice
        lay.append_slices(part, f"{path}/by_lead", "lead", ["feature_id"])
    lay.write_sorted(spark.read.parquet(f"{path}/by_lead"), f"{path}/by_feature", "feature_id")
    back = spark.read.parquet(f"{path}/by_feature")
    return rounded(back.select("feature_id", "reference_time", "time", "streamflow", F.col("lead").cast("int").alias("lead")))


@query("q_archive_two_axis", """
SELECT feature_id, time, round(streamflow, 6) AS streamflow,
       CAST(year(reference_time) * 100 + month(reference_time) AS INTEGER) AS cycle,
       CAST((year(time) - year(reference_time)) * 12 + month(time) - month(reference_time) AS INTEGER) AS lead
FROM forecast""")
def q_archive_two_axis(spark, root):
    fc = fo.with_lead(fx.forecast(spark, root))
    fc = fc.withColumn("cycle", (F.year("reference_time") * 100 + F.month("reference_time")).cast("int"))
    fc = fc.drop("reference_time")
    path = shared_dir(spark, "archive_two_axis")
    lay.write_two_axis(fc, path, "cycle", "lead", ["feature_id"])
    lay.write_two_axis(fc.where(F.col("lead") == 1), path, "cycle", "lead", ["feature_id"])  # rerun of one slice
    back = spark.read.parquet(path)
    return rounded(back.select("feature_id", "time", "streamflow", F.col("cycle").cast("int").alias("cycle"),
                               F.col("lead").cast("int").alias("lead")))


@query("q_sorted_layout", f"""
SELECT feature_id, time, round(streamflow, 6) AS streamflow FROM flow WHERE feature_id = {POINT_FEATURE}""")
def q_sorted_layout(spark, root):
    path = shared_dir(spark, "sorted")
    lay.write_sorted(fx.flow(spark, root), path, "feature_id")
    return rounded(spark.read.parquet(path).where(F.col("feature_id") == POINT_FEATURE))


@query("q_rechunk_rerun", _sql_chunked(*lay.CHUNKS_TRANSPOSED))
def q_rechunk_rerun(spark, root):
    """Two shapes into one folder: only the second is left."""
    path = shared_dir(spark, "chunks_rerun")
    for shape in (lay.CHUNKS_SQUARE, lay.CHUNKS_TRANSPOSED):
        lay.write_chunked(lay.with_chunk_ids(fx.flow(spark, root), *shape), path, ["feature_id", "time"])
    back = lay.read_chunked(spark, path)
    return rounded(back.select("feature_id", "time", "streamflow", "chunk_time", "chunk_feature"))
