"""Connected components of a table of links, by alternating star steps.

Each round points every node's larger neighbours at its smallest one, then
every node's smaller neighbours likewise; the rounds end when the links are a
star per component, which is seen from the links of a round, without another
round that changes nothing.  Every round is written, so a lost executor costs a task,
and no task holds more than the links of its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node to the least of the node and its
    neighbours; of each link (u, v) one link (u > v) remains."""
    both = links.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    """From links with u > v: a node and its smaller neighbours to the least
    of them; of each link one remains, equal ones once."""
    near = links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")
    return near.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()


def _loose(links: DataFrame) -> int:
    """Nodes that keep distinct links u > v from being one star per component:
    those with a smaller neighbour and a second link."""
    ends = links.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(True).alias("larger")), F.struct(F.col("v").alias("node"), F.lit(False).alias("larger")))))
    return ends.groupBy("node").agg(F.bool_or("larger").alias("larger"), F.count(F.lit(1)).alias("n")).filter("larger and n > 1").count()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (its component's least node) for every node that is
    not a root itself, from links (u, v) of comparable ids."""
    now = links.select("u", "v")
    while True:
        now = written(_small(_large(now)), "links")
        if not _loose(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
