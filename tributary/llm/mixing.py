"""Mixing sources to target weights with a low-discrepancy schedule.

* Targets: sources share ``SHARE`` times all words by weight; no source gets
  more than ``REPEATS`` times its own words, and what is cut off goes to the
  others by weight (water level over the sources, in closed form).
* Streams: the documents of a source in hash order are one stream of words,
  read at most ``REPEATS`` times over, cut into blocks of ``BLOCK_WORDS``.
* Schedule: slot ``i`` maps the golden-ratio point ``frac(i * phi)`` through
  the cumulative numbers of blocks to a source; the k-th slot of a source
  takes its k-th block.  The few blocks that a source is short of at the end
  are taken after the last slot, so each source gives exactly its target.

Ranks and stream positions are prefix sums in two levels (hash buckets of a
stream, runs of slots), so a source with a third of all rows is split.

Rows: a null text has no words; a null source is a source of its own, last in
order; repeated rows are rows of their own; rows without words are never
taken.  Other columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fold, match, row_id, written

WEIGHTS = (3, 1, 2)     # of the sources in order, repeating
SHARE = 1.5             # words of the mix, of all words
REPEATS = 2             # times a document may be read
BLOCK_WORDS = 4096
SEED = "mix-1"
BUCKET_DIGITS = 3       # hex digits of the order key: 4096 buckets a source
RUN_SLOTS = 1 << 16
CELLS = 1024
GOLDEN = 0.6180339887498949


def sized(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, source, size and the key of the shuffled order, written once."""
    key = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                               F.regexp_count(fold(), F.lit(WORD)).cast("long").alias("size"), key.alias("key"),
                               row_id(row)), "sizes")


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, target (words, double) and its whole part ``take``."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * REPEATS)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    level = (SHARE * F.sum("source_size").over(everyone) - (F.sum("cap").over(rising) - F.col("cap"))) \
        / (F.sum("weight").over(everyone) - F.sum("weight").over(rising) + F.col("weight"))
    by = by.withColumn("level", level)
    water = F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(everyone)
    target = F.least(F.col("cap").cast("double"), F.coalesce(water, F.lit(0.0)) * F.col("weight"))
    return by.withColumn("target", target).select(
        "source", "source_size", "target", F.floor(F.col("target") + 1e-6).cast("long").alias("take"))


def streams(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` with ``begin``: words before the row in its source's stream."""
    rows = rows.filter("size > 0").withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size", "row")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = buckets.withColumn("bucket_begin", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words"))
    placed = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    placed = match(placed, before.drop("words"), ["source", "bucket"]) \
        .select("row", "doc_id", "source", "size", (F.col("bucket_begin") + F.col("inside")).alias("begin"))
    return match(placed, goal.drop("target"), ["source"])


def pieces(placed: DataFrame) -> DataFrame:
    """row, doc_id, source, block, first word of the piece in its document, words."""
    turn = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("turn")) \
        .withColumn("lo", F.col("begin") + F.col("turn") * F.col("source_size")) \
        .withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("take"))).filter("lo < hi")
    cut = turn.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {BLOCK_WORDS}"), F.expr(f"(hi - 1) div {BLOCK_WORDS}"))))
    start = F.greatest(F.col("lo"), F.col("block") * BLOCK_WORDS)
    stop = F.least(F.col("hi"), (F.col("block") + 1) * BLOCK_WORDS)
    return cut.select("row", "doc_id", "source", "block", (start - F.col("lo")).alias("first"), (stop - start).alias("words"))


def schedule(spark: SparkSession, goal: DataFrame) -> DataFrame:
    """slot, source, block: every block that the mix takes, in its order."""
    blocks = goal.select("source", F.ceil(F.col("take") / BLOCK_WORDS).cast("long").alias("blocks"),
                         F.coalesce(F.col("source"), F.lit("")).alias("name"), F.col("source").isNull().alias("none"))
    last = Window.orderBy("none", "name")
    upto = blocks.withColumn("upto", F.sum("blocks").over(last)).filter("blocks > 0")
    total = upto.agg(F.max("upto")).first()[0] or 0     # one number
    share = upto.select("source", "blocks", (F.col("upto") - F.col("blocks")).alias("first"), ((F.col("upto") - F.col("blocks")) / max(total, 1)).alias("lo"),
                        (F.col("upto") / max(total, 1)).alias("hi"))
    cells = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS)))))
    # frac(i * phi) with i in two parts, so that large slots keep their digits
    high = (GOLDEN * (1 << 20)) % 1.0
    point = F.pmod(F.expr("id div 1048576") * F.lit(high) + F.expr("id % 1048576") * F.lit(GOLDEN), F.lit(1.0))
    slots = spark.range(total).withColumn("u", point).withColumn("cell", F.floor(F.col("u") * CELLS)) \
        .join(cells, "cell").filter("u >= lo and u < hi") \
        .select(F.col("id").alias("slot"), "source", "blocks", F.expr(f"id div {RUN_SLOTS}").alias("run"))
    runs = slots.groupBy("source", "run").agg(F.count(F.lit(1)).alias("n"))
    before = runs.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("run")) - F.col("n"))
    ranked = slots.withColumn("k", F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1)
    ranked = match(ranked, before.drop("n"), ["source", "run"]) \
        .select("slot", "source", "blocks", (F.col("before") + F.col("k")).alias("block")).filter("block < blocks")
    got = runs.groupBy("source").agg(F.sum("n").alias("slots"))
    short = match(share.select("source", "blocks", "first"), got, ["source"], "left") \
        .select("source", "blocks", "first", F.coalesce("slots", F.lit(0)).alias("slots")).filter("slots < blocks") \
        .select("source", "first", F.explode(F.sequence("slots", F.col("blocks") - 1)).alias("block"))
    return ranked.select("slot", "source", "block") \
        .unionByName(short.select((total + F.col("first") + F.col("block")).alias("slot"), "source", "block"))


def mixture(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """The mix: one row per slot and piece of a document
    (slot, source, row, doc_id, first, words)."""
    placed = pieces(streams(rows, goal))
    slots = schedule(rows.sparkSession, goal)
    return match(slots, placed, ["block", "source"]).select("slot", "source", "row", "doc_id", "first", "words")


def taken(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Per document: row, doc_id, source, size, source_size, target, taken."""
    rows = sized(docs, row)
    goal = written(targets(rows), "targets")
    got = mixture(rows, goal).groupBy("row").agg(F.sum("words").alias("taken"))
    return match(rows.join(got, "row", "left"), goal, ["source"]).select(
        "row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
