"""Named queries over timing results (summaries, labels, ratios, UDF variants)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results as rs
from ..operators.climatology import mean_all_numeric
from ..operators.udf import speedup_per_group
from ..session import shared_dir
from ..sources import fixtures as fx
from ..sources.files import read_csv, write_csv
from .common import rounded
from .registry import query

# Which timing rows came from the table store, the chunk
# shapes of the two chunked stores, and the worker count of the second set
# (a float, as a column missing from one side of a concatenation becomes).
PARQUET_QUERY = "N"
NB_WORKERS = 16


def labelled(spark, root):
    r = fx.results(spark, root)
    parquet = F.col("query") == PARQUET_QUERY
    base = F.col("source") == "base"
    r = (r.withColumn("data_format", F.when(parquet, "parquet").otherwise("zarr"))
          .withColumn("time_chunk_sz", F.when(parquet, rs.UNKNOWN_CHUNK).when(base, 672).otherwise(30000))
          .withColumn("feature_id_chunk_sz", F.when(parquet, rs.UNKNOWN_CHUNK).when(base, 30000).otherwise(672)))
    return rs.with_labels(r)


_SQL_LABELLED = f"""(SELECT *, '(' || time_chunk_sz || ', ' || feature_id_chunk_sz || ')' AS chunk_sz,
   '(' || time_chunk_sz || ', ' || feature_id_chunk_sz || ')' AS chunk_shape, time AS run_time_secs,
   nb_days AS days_in_query,
   CASE WHEN data_format = 'zarr' THEN 'zarr (' || time_chunk_sz || ', ' || feature_id_chunk_sz || ')'
        ELSE data_format END AS data_format_label
 FROM (SELECT *, CASE WHEN query = '{PARQUET_QUERY}' THEN 'parquet' ELSE 'zarr' END AS data_format,
   CASE WHEN query = '{PARQUET_QUERY}' THEN {rs.UNKNOWN_CHUNK} WHEN source = 'base' THEN 672 ELSE 30000 END
     AS time_chunk_sz,
   CASE WHEN query = '{PARQUET_QUERY}' THEN {rs.UNKNOWN_CHUNK} WHEN source = 'base' THEN 30000 ELSE 672 END
     AS feature_id_chunk_sz FROM results))"""


@query("q_result_summary", """
SELECT query, source, nb_days, round(avg(time), 6) AS time_mean, round(stddev_pop(time), 6) AS time_std,
       count(*) AS nb_repeats FROM results GROUP BY 1, 2, 3""")
def q_result_summary(spark, root):
    return rounded(rs.summarize(fx.results(spark, root), ["query", "source", "nb_days"]))


@query("q_result_labels", f"""
SELECT query, nb_days, source, round(time, 6) AS time, data_format, time_chunk_sz, feature_id_chunk_sz, chunk_sz,
       chunk_shape, round(run_time_secs, 6) AS run_time_secs, days_in_query, data_format_label
FROM {_SQL_LABELLED}""")
def q_result_labels(spark, root):
    return rounded(labelled(spark, root))


@query("q_result_bars", f"""
SELECT query, nb_days, data_format_label, round(avg(time), 6) AS time_mean FROM {_SQL_LABELLED} GROUP BY 1, 2, 3""")
def q_result_bars(spark, root):
    return rounded(rs.bars(labelled(spark, root)))


@query("q_group_mean_all", f"""
SELECT chunk_sz, round(avg(nb_days), 6) AS nb_days, round(avg(time), 6) AS time,
       round(avg(time_chunk_sz), 6) AS time_chunk_sz, round(avg(feature_id_chunk_sz), 6) AS feature_id_chunk_sz,
       round(avg(run_time_secs), 6) AS run_time_secs, round(avg(days_in_query), 6) AS days_in_query
FROM {_SQL_LABELLED} WHERE time_chunk_sz <> {rs.UNKNOWN_CHUNK} GROUP BY 1""")
def q_group_mean_all(spark, root):
    lab = labelled(spark, root).where(F.col("time_chunk_sz") != rs.UNKNOWN_CHUNK)
    return rounded(mean_all_numeric(lab, ["chunk_sz"]))


@query("q_format_ratio", f"""
SELECT round(avg(time) FILTER (WHERE data_format = 'parquet') / avg(time) FILTER (WHERE data_format = 'zarr'), 6)
         AS ratio,
       printf('%.2f', round(avg(time) FILTER (WHERE data_format = 'parquet')
                            / avg(time) FILTER (WHERE data_format = 'zarr'), 2)) AS ratio_text
FROM {_SQL_LABELLED}""")
def q_format_ratio(spark, root):
    r = rs.ratio_of_means(labelled(spark, root), F.col("data_format") == "parquet", F.col("data_format") == "zarr")
    return rounded(r.select("ratio", F.format_string("%.2f", F.round("ratio", 2)).alias("ratio_text")))


_SQL_SPEEDUP = """
SELECT query, nb_days, round(avg(time) FILTER (WHERE source = 'base')
                             / avg(time) FILTER (WHERE source = 'rechunked'), 6) AS speedup
FROM results GROUP BY 1, 2"""


@query("q_speedup", _SQL_SPEEDUP)
def q_speedup(spark, root):
    r = rs.ratio_of_means(fx.results(spark, root), F.col("source") == "base", F.col("source") == "rechunked",
                          ["query", "nb_days"])
    return rounded(r.withColumnRenamed("ratio", "speedup"))


@query("q_speedup_apply", _SQL_SPEEDUP)
def q_speedup_apply(spark, root):
    return rounded(speedup_per_group(fx.results(spark, root)))


@query("q_concat_results", f"""
SELECT query, nb_days, source, round(time, 6) AS time, NULL::DOUBLE AS nb_workers FROM results WHERE source = 'base'
UNION ALL
SELECT query, nb_days, source, round(time, 6) AS time, CAST({NB_WORKERS} AS DOUBLE) AS nb_workers FROM results WHERE source = 'rechunked'""")
def q_concat_results(spark, root):
    r = fx.results(spark, root)
    a = r.where(F.col("source") == "base")
    b = r.where(F.col("source") == "rechunked").withColumn("nb_workers", F.lit(float(NB_WORKERS)))
    return rounded(rs.concat_results(a, b))


_CSV_SCHEMA = "query string, nb_days int, source string, time double"


@query("q_results_csv", "SELECT query, nb_days, source, round(time, 6) AS time FROM results")
def q_results_csv(spark, root):
    path = shared_dir(spark, "results_csv")
    write_csv(fx.results(spark, root), path)
    return rounded(read_csv(spark, path, _CSV_SCHEMA))
