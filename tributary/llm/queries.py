"""The ``op<N>_<name>`` queries: each applies its operator to its whole table
and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scan
from . import alignment, attention_lm, best_fit, divergence, exact_dedup, id_files, language, license_rules, minhash, mixing, ngram_join, quality_rules, toxicity
from .common import documents, fold_crc, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
LM_END_ID = 49407   # the tokenizer's own end-of-text id, which no text is encoded to


def query(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run
    return deco


@query("op1_token_ids")
def op1(spark, sf_dir):
    """Bit-packed token ids, written and read back."""
    return id_files.read_index(
        id_files.write_ids(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), END_ID))


@query("op3_best_fit")
def op3(spark, sf_dir):
    """Best-fit decreasing packing into 4096-token sequences."""
    return best_fit.best_fit(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), END_ID)


OP4_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  md5('mix-1:' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [3, 1, 2][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
c AS (SELECT *, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - (sum(cap) OVER r - cap))
             / (sum(w) OVER () - sum(w) OVER r + w) AS lv FROM c
      WINDOW r AS (ORDER BY cap / w, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT max(lv) FROM l WHERE cap / w > lv), 0.0) * w) AS target FROM l),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS a FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(a + size, floor(target + 1e-6)) - a)
            + greatest(0, least(a + size + source_size, floor(target + 1e-6)) - a - source_size) AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""


@query("op4_mixing", OP4_SQL)
def op4(spark, sf_dir):
    """Words that the low-discrepancy mix takes of each document."""
    return mixing.taken(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
"""


@query("op6_exact_dedup", OP6_SQL)
def op6(spark, sf_dir):
    """Groups of equal texts; the least doc_id of each stays."""
    return exact_dedup.exact_groups(documents(spark, sf_dir)).drop("row")


@query("op8_quality_rules")
def op8(spark, sf_dir):
    """Base counts and the risk-controlled verdict."""
    return quality_rules.judge(documents(spark, sf_dir), scan(spark, sf_dir, "labels"))


@query("op2_language")
def op2(spark, sf_dir):
    """Predicted language of every text."""
    docs = documents(spark, sf_dir)
    held = F.coalesce(fold_crc(4) == 2, F.lit(False))
    train = docs.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()) \
        .select("text", "lang", F.col("doc_id").alias("order"))
    out = language.predict(docs, language.fit(train))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def toxic_training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows that may be learned from: crc32(doc_id) mod 5 is not 0."""
    return toxicity.labelled(docs, labels, fold_crc(5) != 0)


@query("op9_toxicity")
def op9(spark, sf_dir):
    """Toxicity of every text by its nearest labelled examples."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(toxic_training(docs, scan(spark, sf_dir, "labels")))
    return toxicity.score_texts(docs, *model).select(
        "doc_id", F.coalesce(fold_crc(5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_ngram_join")
def op10(spark, sf_dir):
    """Components of documents whose 4-word shingle sets link."""
    return ngram_join.near_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query("op5_attention_lm")
def op5(spark, sf_dir):
    """Log-probability of every text under the attention model and under word counts."""
    held = F.coalesce(fold_crc(5) == 1, F.lit(False))
    return attention_lm.score_documents(documents(spark, sf_dir), held, public_tokenizers.path(TOKENIZER), LM_END_ID)


@query("op7_license_rules")
def op7(spark, sf_dir):
    """Known licence sentences of every text and the licences that they make up."""
    return license_rules.scan_licences(documents(spark, sf_dir)).select(
        "doc_id", F.size("sentences").alias("n_sentences"), F.array_join("sentences", " ").alias("sentence_ids"),
        F.array_join(F.transform("licences", lambda x: x["licence"]), " ").alias("licences"))


@query("op11_alignment")
def op11(spark, sf_dir):
    """Overlap links, groups and corpus counts of two tokenizers' tokens."""
    return alignment.corpus_alignment(documents(spark, sf_dir), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


OP13_SQL = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
n AS (SELECT row_number() OVER () AS doc, * FROM d),
o AS (SELECT doc, lang, source, unnest(words) AS term FROM n),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v.v) AS p
      FROM t JOIN k ON t.lang = k.lang JOIN v ON t.lang = v.lang
      LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (coalesce(sum(c.n), 0) + 1)) // (any_value(w.total) + any_value(v.v)) AS q
      FROM k JOIN v ON k.lang = v.lang JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY lang) w ON k.lang = w.lang
      LEFT JOIN c ON c.lang = k.lang AND c.term = k.term GROUP BY k.lang, k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, CAST(((p.p - q.q) * (p.p - q.q)) // q.q AS BIGINT)
      FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r)
SELECT * FROM s WHERE part = 'pair' OR rank <= 200
"""


@query("op13_divergence", OP13_SQL)
def op13(spark, sf_dir):
    """How far a language's sources differ, and by which terms."""
    return divergence.divergence(documents(spark, sf_dir))


@query("op12_minhash")
def op12(spark, sf_dir):
    """Components of documents whose 2-word shingle sets are near copies."""
    return minhash.near_groups(documents(spark, sf_dir))
