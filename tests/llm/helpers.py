"""Small document tables for the training-data operators, and brute-force
versions of what they compute."""

import re

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "kept boolean, row long, row_number long, start long, score double, keep_id long, words string, block int, n int, size int, key string")
LONG = " ".join(f"word{i % 977} tail{i % 31}," for i in range(12_000))
BASE = " ".join(f"w{i}" for i in range(60))
EDGE = [
    (1, "Alpha beta  gamma delta epsilon zeta", "en", "b"),
    (2, None, "en", "b"),
    (3, "", "de", None),
    (4, " \t\n\x0b\x0c\r ", None, "a"),
    (5, LONG, "en", "a"),
    (6, "Alpha beta gamma\n\ndelta epsilon zeta", "en", "b"),
    (7, "repeated row text", "fr", "c"),
    (7, "repeated row text", "fr", "c"),
    (None, "no id here", "fr", "c"),
    (None, "no id here", None, None),
    (8, "Üñï ΟΔΟΣ İi don't I'M 's <|endoftext|> <|EndOfText|> äb ﬁ 漢字かな 12²½ é", "de", "a"),
    (9, BASE, "en", "a"),
    (10, BASE + " extra", "en", "é"),
    (11, BASE.replace("w30", "changed"), "en", "a"),
    (12, "one", "en", "Z"),
    (13, "One", "en", "Z"),
    (14, "x\x1cy z   w", "es", "Z"),
    (-5, "negative id\nnegative id\nother line\nnegative id", "es", "a"),
]


def wide(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names clash with
    those the operators use."""
    data = [(i, t, lang, s, len(t or ""), None, 3, 4, 5, 0.5, 6, "w", 7, 8, 9, "k") for i, t, lang, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def real_rows():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang", "source"]).to_pylist()
    return [(r["doc_id"] + 100, r["text"], r["lang"], r["source"]) for r in t]


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def order(value):
    return (value is not None, value or 0)
