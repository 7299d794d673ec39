"""Attaching global aggregates to rows, and the broadcast policy.

Only one kind of value is pushed to every row explicitly: a *global
aggregate*, which has exactly one row whatever the input size.  It enters as
a scalar subquery: Spark runs the aggregate once (partial aggregation on
every task, one row to the final step) and substitutes the value, so the
outer plan has no join at all.

Every join elsewhere leaves the strategy to Spark, which broadcasts a side
only below ``spark.sql.autoBroadcastJoinThreshold`` (checked from
statistics, or at run time by AQE) and uses a shuffle join beyond it.  The
exception are rows that an ``explode`` made: the statistics count them as the
rows before it, so a side of any size can pass for a small one and end in the
driver.  Those are marked by :func:`by_shuffle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar(one_row: DataFrame) -> Column:
    """The single row of a global aggregate as a struct-valued scalar subquery."""
    return one_row.select(F.struct(*one_row.columns)).scalar()


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row global aggregate to every row of ``df``."""
    s = scalar(one_row)
    return df.select("*", *[s[c].alias(c) for c in one_row.columns])


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not broadcast, whatever the statistics say."""
    return df.hint("merge")
