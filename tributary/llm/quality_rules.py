"""Quality rules whose cutoffs are set by risk control.

Signals of a text (shares of symbols, capitals, exclamation marks, repeated
windows, repeated lines) are compared with cutoffs, one per signal and
stratum (the document's language).  Labelled documents decide: for a stratum
and a signal the cutoffs are tested from the most lenient to the strictest,
each by the exact binomial test that the rule rejects more than
``MAX_FALSE_REJECTION`` of the good documents; testing stops at the first
cutoff that is not certified (fixed-sequence testing), and the level is
``ERROR / (strata * signals)`` (Bonferroni over all sequences, strata counted
exactly).  So with probability ``1 - ERROR`` no rule in use rejects more good
documents of any stratum than allowed; the verdict, which any rule can turn,
rejects at most that share times the number of signals in use there.  Of the certified cutoffs the one that rejects most bad
documents is used (the most lenient of equals), if it rejects at least
``MIN_BAD_REJECTION`` of them; else the signal rejects nothing there.

Everything is DataFrame functions.  Three-word windows are compared by 64-bit
hashes: hash and position share one long, a primitive sort brings equal
windows together, and full hashes are compared; a document where two hashes
agree in the kept bits only is sorted as (hash, position) pairs instead.

Rows: null and empty texts have no words and fail the base rules; repeated
rows get equal results; a null language is a stratum of its own; of repeated
labels of a document the lowest counts, null labels are ignored; no labels
leave the base rules alone.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import with_scalars
from .common import ASCII_SPACE, GAP, fold, written

MAX_FALSE_REJECTION = 0.005
ERROR = 0.1
MIN_BAD_REJECTION = 0.02
SYMBOLS = "#*$%&|<>"
# Cutoffs of each signal, a row is rejected above; from lenient to strict.
CUTOFFS = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "upper_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08),
    "bang_share": (0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01),
    "repeat_share": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "dup_line_share": (0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.025, 0.02, 0.015, 0.01, 0.0075, 0.005),
}


def _without(column: Column, chars: str) -> Column:
    for c in chars:
        column = F.replace(column, F.lit(c), F.lit(""))
    return column


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` to rows with ``words`` and ``n_words``."""
    df = df.withColumn("h", F.expr(
        "transform(slice(words, 1, greatest(n_words - 2, 0)), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2)))"))
    df = df.withColumn("b", F.expr("length(bin(size(h)))")).withColumn("mask", F.expr("shiftleft(1L, b) - 1L"))
    df = df.withColumn("c", F.expr("sort_array(transform(h, (x, i) -> shiftleft(shiftright(x, b), b) | cast(i as bigint)))"))
    near = "shiftright(x, b) = shiftright(get(c, i - 1), b)"
    same = "get(h, cast(x & mask as int)) = get(h, cast(get(c, i - 1) & mask as int))"
    # Positions in c whose window equals the one before; -2: hashes that agree only in part.
    df = df.withColumn("near", F.expr(
        f"filter(transform(c, (x, i) -> case when i = 0 or not ({near}) then -1 when {same} then i else -2 end), i -> i != -1)"))
    df = df.withColumn("pairs", F.expr("if(array_contains(near, -2), null, near)"))
    long_way = ("transform(array_sort(transform(h, (x, i) -> struct(x as x, i as i))), (s, j) -> s)")
    df = df.withColumn("p", F.when(F.col("pairs").isNotNull(), F.expr(
        "array_sort(array_distinct(flatten(transform(pairs, i -> array(cast(get(c, i) & mask as int), cast(get(c, i - 1) & mask as int))))))"
    )).otherwise(F.expr(
        f"aggregate({long_way}, struct(cast(null as bigint) as x, -1 as i, cast(array() as array<int>) as p),"
        " (a, s) -> struct(s.x as x, s.i as i, if(a.x = s.x, array_append(array_append(a.p, a.i), s.i), a.p) as p),"
        " a -> array_sort(array_distinct(a.p)))")))
    covered = F.expr("aggregate(p, struct(-3 as last, 0L as n), (a, x) -> struct(x as last, a.n + least(3, x - a.last) as n), a -> a.n)")
    return df.withColumn("n_repeat_words", covered).drop("h", "b", "mask", "c", "near", "pairs", "p")


def signals(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, stratum, the base counts and the signals."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), fold().alias("text"))
    bare = F.btrim(F.col("text"), F.lit(ASCII_SPACE))
    df = df.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP)))
    df = df.withColumn("n_words", F.size("words").cast("int")).withColumn(
        "lines", F.expr("filter(split(text, '\\n', -1), l -> btrim(l, ws) != '')".replace("ws", _sql(ASCII_SPACE))))
    df = df.select(
        "doc_id", "stratum", "n_words", "words",
        F.length(_without(F.col("text"), ASCII_SPACE)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(_without(F.col("text"), "!"))).alias("n_bangs"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).alias("n_upper"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    df = _repeat_words(df)
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    return df.select(
        "doc_id", "stratum", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbol_share"), (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_bangs") / chars).alias("bang_share"), (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_dup_lines") / words).alias("dup_line_share"))


def _sql(text: str) -> str:
    return "concat(" + ", ".join(f"char({ord(c)})" for c in text) + ")"


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), summed term by term in logarithms;
    1 where k is above the mean (never certified)."""
    import math
    odds = math.log(rate / (1 - rate))
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct((n * math.log(1 - rate)).cast("double").alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] + F.log(F.greatest(n - i, F.lit(1)).cast("double")) - F.log((i + 1).cast("double")) + F.lit(odds)).alias("term"),
            (a["sum"] + F.exp(a["term"])).alias("sum")),
        lambda a: a["sum"])
    return F.when(k > n * rate, F.lit(1.0)).otherwise(terms)


def with_level(tests: DataFrame, counts: DataFrame) -> DataFrame:
    """Add the ``level`` of one test; ``counts`` has one row per stratum."""
    out = with_scalars(tests, counts.agg(F.count(F.lit(1)).alias("strata")))
    return out.withColumn("level", F.lit(ERROR) / (F.col("strata") * len(CUTOFFS))).drop("strata")


def thresholds(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Cutoffs in use: stratum, and one column per signal (null: none)."""
    marks = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.min("quality").alias("quality"))
    known = rows.filter("not base_failed").join(marks, "doc_id")
    good, sums = F.col("quality") == 1, []
    for name, cuts in CUTOFFS.items():
        for j, cut in enumerate(cuts):
            above = F.col(name) > cut
            sums += [F.count_if(above & good).alias(f"{name}_{j}_good"), F.count_if(above & ~good).alias(f"{name}_{j}_bad")]
    counts = known.groupBy("stratum").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), *sums)
    counts = written(counts, "strata")
    tests = counts.select("stratum", "good", "bad", F.explode(F.array(*[
        F.struct(F.lit(name).alias("signal"), F.lit(j).alias("j"), F.lit(float(cut)).alias("cut"),
                 F.col(f"{name}_{j}_good").alias("false"), F.col(f"{name}_{j}_bad").alias("hits"))
        for name, cuts in CUTOFFS.items() for j, cut in enumerate(cuts)])).alias("t")).select("stratum", "good", "bad", "t.*")
    tests = with_level(tests, counts).withColumn("p", binomial_tail(F.col("good"), F.col("false"), MAX_FALSE_REJECTION))
    path = Window.partitionBy("stratum", "signal").orderBy("j")
    tests = tests.withColumn("certified", F.min((F.col("p") <= F.col("level")).cast("int")).over(path) == 1)
    useful = tests.filter(F.col("certified") & (F.col("hits") >= F.lit(MIN_BAD_REJECTION) * F.col("bad")) & (F.col("hits") > 0))
    best = useful.groupBy("stratum", "signal").agg(F.max(F.struct("hits", "cut")).alias("best"))
    return best.groupBy("stratum").pivot("signal", list(CUTOFFS)).agg(F.first("best.cut"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: the base counts, ``base_failed`` and ``kept``."""
    rows = written(signals(docs), "signals")
    cuts = thresholds(rows, labels)
    cuts = cuts.select(F.col("stratum").alias("cut_stratum"), *[F.col(s).alias(f"cut_{s}") for s in CUTOFFS])
    joined = rows.join(cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    rejected = F.lit(False)
    for s in CUTOFFS:
        rejected = rejected | F.coalesce(F.col(s) > F.col(f"cut_{s}"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & ~rejected).alias("kept"))
