"""The two user-function surfaces of the reference, as Arrow-batched pandas UDFs.

* :func:`map_batches` - a function mapped over row batches in parallel
  (a bag ``map``); Spark hands each task Arrow batches, never a whole table.
* :func:`speedup_per_group` - a scalar per group.  Rows are pre-aggregated
  with built-in functions first (one row per group and source), so each
  pandas group holds two rows, whatever the input size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def _speedup(pdf: pd.DataFrame) -> pd.DataFrame:
    base = pdf.loc[pdf["source"] == "base", "time_mean"]
    other = pdf.loc[pdf["source"] == "rechunked", "time_mean"]
    ratio = float(base.iloc[0] / other.iloc[0]) if len(base) and len(other) else float("nan")
    return pd.DataFrame({"query": [pdf["query"].iloc[0]], "nb_days": [int(pdf["nb_days"].iloc[0])],
                         "speedup": [ratio]})


def speedup_per_group(results: DataFrame) -> DataFrame:
    """Base mean time over rechunked mean time per ``(query, nb_days)``."""
    means = results.groupBy("query", "nb_days", "source").agg(F.avg("time").alias("time_mean"))
    return means.groupBy("query", "nb_days").applyInPandas(_speedup, "query string, nb_days int, speedup double")
