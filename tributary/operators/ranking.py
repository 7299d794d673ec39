"""Global order statistics without a single-partition window.

``cumulative_counts`` gives, for every distinct value of a column, the
number of rows with a smaller value (``rank_start``) and its own count.
It is the basis of dense label positions (W1) and exact quantiles (A13).

Plan: distinct values are cut into ordered buckets at bounds taken from a
hash sample of the *distinct* values, so one hot value cannot unbalance a
bucket; a window ranks the values inside each bucket; bucket totals, one row
per bucket, give each bucket's offset.  Bounds and values are compared in the
column's own type, so big integers keep their order and text works too.  The
sample is the only thing that reaches the driver: at most ``SAMPLE_LABELS``
values per column (four per bucket beyond that).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_B = "_bucket"

# Distinct values sampled per column, and the distinct values
# that one bucket (one window partition) should hold.
SAMPLE_LABELS = 2048
VALUES_PER_BUCKET = 1_000_000


def default_buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def _order(label: str):
    """Sort key of a label's text; only the balance of buckets depends on it."""
    try:
        return 0, float(label), label
    except ValueError:
        return 1, 0.0, label


def label_bounds(df: DataFrame, cols: list[str], n_buckets: int | None = None) -> dict[str, list[str]]:
    """Bucket bounds per column, as text, from one query over all columns.

    The sample holds the distinct values with the smallest hashes; how far
    their hashes reach tells how many distinct values there are, and so how
    many buckets are wanted.  More buckets than the sample serves take a
    second, larger sample; there is no upper limit.
    """
    size = SAMPLE_LABELS if n_buckets is None else max(SAMPLE_LABELS, 4 * n_buckets)
    found: dict[str, list[str]] = {}
    todo = list(cols)
    while todo:
        parts = [df.select(F.col(c).alias("v")).where(F.col("v").isNotNull()).distinct()
                   .select(F.lit(i).alias("axis"), F.col("v").cast("string").alias("label"), F.xxhash64("v").alias("h"))
                   .orderBy("h").limit(size) for i, c in enumerate(todo)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        sample: dict[str, list] = {c: [] for c in todo}
        for r in rows.collect():
            sample[todo[r["axis"]]].append((r["label"], r["h"]))
        again, largest = [], size
        for c, got in sample.items():
            reach = (max((h for _, h in got), default=0) + 2 ** 63 + 1) / 2 ** 64
            distinct = len(got) if len(got) < size else int((size - 1) / reach)
            wanted = n_buckets or max(default_buckets(df), -(-distinct // VALUES_PER_BUCKET))
            if 4 * wanted > size and len(got) == size:
                again.append(c)
                largest = max(largest, 4 * wanted)
                continue
            labels = sorted((label for label, _ in got), key=_order)
            step = len(labels) / wanted
            found[c] = sorted({labels[int(i * step)] for i in range(1, wanted) if int(i * step) > 0}) if labels else []
        todo, size = again, largest
    return found


def _with_bucket(dist: DataFrame, col: str, bounds: list[str]) -> DataFrame:
    """Bucket index: how many bounds are below the value (monotone in it)."""
    if not bounds:
        return dist.withColumn(_B, F.lit(0))
    kind = dist.schema[col].dataType
    arr = F.array(*[F.lit(b).cast(kind) for b in bounds])
    return dist.withColumn(_B, F.size(F.filter(arr, lambda b: b < F.col(col))))


def _cumulative(dist: DataFrame, col: str, bounds: list[str]) -> DataFrame:
    """``(col, n, rank_start)`` from distinct values with their counts ``n``."""
    dist = _with_bucket(dist, col, bounds)
    w = Window.partitionBy(_B).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    local = dist.withColumn("_local", F.coalesce(F.sum("n").over(w), F.lit(0)))
    totals = dist.groupBy(_B).agg(F.sum("n").alias("_bn"))      # one row per bucket
    ow = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_B, F.coalesce(F.sum("_bn").over(ow), F.lit(0)).alias("_off"))
    return local.join(offsets, _B).select(col, "n", (F.col("_off") + F.col("_local")).alias("rank_start"))


def frequencies(df: DataFrame, col: str) -> DataFrame:
    """``(col, n)``: rows of each distinct non-null value."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def cumulative_counts(df: DataFrame, col: str, n_buckets: int | None = None) -> DataFrame:
    """``(col, n, rank_start)`` for each distinct non-null value of ``col``."""
    return _cumulative(frequencies(df, col), col, label_bounds(df, [col], n_buckets)[col])


def axis_positions(df: DataFrame, axes: dict[str, str], n_buckets: int | None = None) -> dict[str, DataFrame]:
    """Per axis column a table ``(col, name)`` of 0-based positions of its
    distinct labels in order (W1); all bounds come from one query."""
    bounds = label_bounds(df, list(axes), n_buckets)
    out = {}
    for col, name in axes.items():
        labels = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("n", F.lit(1).cast("long"))
        out[col] = _cumulative(labels, col, bounds[col]).select(col, F.col("rank_start").alias(name))
    return out


def dense_positions(df: DataFrame, col: str, name: str = "pos", n_buckets: int | None = None) -> DataFrame:
    """``(col, pos)``: 0-based position of each distinct label on its sorted axis."""
    return axis_positions(df, {col: name}, n_buckets)[col]


def join_positions(df: DataFrame, axes: dict[str, str], n_buckets: int | None = None) -> DataFrame:
    """``df`` with the position of each axis label attached.  Rows with a null
    label are kept, their position is null.  Spark chooses the join (it
    broadcasts the label table only below its own size threshold)."""
    out = df
    for col, pos in axis_positions(df, axes, n_buckets).items():
        out = out.join(pos, col, "left")
    return out


def quantiles_of(freq: DataFrame, col: str, probs: list[float], names: list[str], n_buckets: int | None = None) -> DataFrame:
    """One row of exact quantiles with linear interpolation between ranks
    (the ``quantile_cont`` / numpy ``linear`` definition) of values given with
    their frequencies ``(col, n)`` (A13)."""
    cc = _cumulative(freq, col, label_bounds(freq, [col], n_buckets)[col])
    j = cc.withColumn("_total", freq.agg(F.sum("n")).scalar())
    aggs = []
    for p, name in zip(probs, names):
        k = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.floor(k), F.ceil(k)
        holds = lambda r: (F.col("rank_start") <= r) & (r < F.col("rank_start") + F.col("n"))
        aggs += [F.max(F.when(holds(lo), F.col(col))).alias(f"_{name}_lo"),
                 F.max(F.when(holds(hi), F.col(col))).alias(f"_{name}_hi"),
                 F.max(k - lo).alias(f"_{name}_f")]
    one = j.agg(*aggs)
    return one.select(*[(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n)
                        for n in names])


def exact_quantiles(df: DataFrame, col: str, probs: list[float], names: list[str],
                    n_buckets: int | None = None) -> DataFrame:
    """One row of exact quantiles of the non-null values of ``col``."""
    return quantiles_of(frequencies(df, col), col, probs, names, n_buckets)


