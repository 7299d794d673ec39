"""Mixing (4), exact dedup (6), licence rules (7) and quality rules (8)."""

import collections
import hashlib
import math
import re

import pytest
from helpers import EDGE, real_rows, wide, words
from pyspark.sql import functions as F

from tributary.llm import exact_dedup, license_rules, mixing, quality_rules
from tributary.llm.common import prepare

ROWS = EDGE + real_rows()


# ---- mixing ----------------------------------------------------------------

def brute_targets(sizes):
    """Iterated sharing: cap, share the excess again by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, free = 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        w = sum(weight[s] for s in free)
        give = {s: left * weight[s] / w for s in free}
        left = 0.0
        for s in list(free):
            target[s] += give[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def test_mixing(spark):
    got = mixing.taken(wide(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(words(t))) for i, t, _, _ in ROWS)
    sizes = collections.Counter()
    for _, t, _, s in ROWS:
        sizes[s] += len(words(t))
    target, taken = brute_targets(sizes), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.taken(wide(spark, ROWS)).collect()
    assert sorted(map(str, [(r.doc_id, r.size, r.taken) for r in got])) == sorted(map(str, [(r.doc_id, r.size, r.taken) for r in again]))


def test_mix_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    monkeypatch.setattr(mixing, "RUN_SLOTS", 16)
    rows = mixing.sized(wide(spark, ROWS))
    goal = mixing.targets(rows)
    mix = mixing.mixture(rows, goal).collect()
    total = {r.source: r.take for r in goal.collect()}
    slots = collections.defaultdict(int)
    for r in mix:
        slots[r.slot, r.source] += r.words
    by = collections.defaultdict(list)
    for (slot, source), n in slots.items():
        by[source].append(n)
        assert n <= 64
    for source, n in total.items():
        assert sum(by[source]) == n and len(by[source]) == math.ceil(n / 64)
    assert len({s for s, _ in slots}) == len(slots)
    # low discrepancy: every prefix of the schedule has each large source near its share
    order = sorted(slots)
    big = max(total, key=total.get)
    share, seen = math.ceil(total[big] / 64) / len(order), 0
    for k, (_, source) in enumerate(order, 1):
        seen += source == big
        assert abs(seen - share * k) < 6


def test_mixing_empty(spark):
    assert mixing.taken(wide(spark, EDGE).limit(0)).count() == 0
    assert [r.taken for r in mixing.taken(wide(spark, [(1, None, "en", "a"), (2, " ", "en", None)])).collect()] == [0, 0]


# ---- exact dedup -----------------------------------------------------------

def test_exact_dedup(spark):
    got = exact_dedup.exact_groups(wide(spark, ROWS)).collect()
    sha = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t, _, _ in ROWS]
    groups = collections.defaultdict(list)
    for (i, *_), h in zip(ROWS, sha):
        groups[h].append(i)
    want = []
    for (i, *_), h in zip(ROWS, sha):
        ids = [x for x in groups[h] if x is not None]
        want.append((str(i), str(min(ids) if ids else None), len(groups[h]), h))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted(want)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert kept == collections.Counter(set(sha))       # one row of each group, also of repeated ids
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_groups(wide(spark, EDGE).limit(0)).count() == 0


def test_bloom_passes(spark, monkeypatch):
    """No repeated hash is missed, few single ones pass; a full filter stays right."""
    rows = spark.range(4000).select((F.when(F.col("id") < 400, F.col("id") % 150).otherwise(F.col("id"))).alias("x")) \
        .select(F.col("x").alias("doc_id"), F.sha2(F.col("x").cast("string"), 256).alias("text_sha256"),
                F.xxhash64("x").alias("h"), F.monotonically_increasing_id().alias("row")).repartition(5)
    bits = exact_dedup.filter_bits(4000)
    got = exact_dedup.flag_repeats(rows, bits).collect()
    n = collections.Counter(r.h for r in got)
    assert all(r.maybe for r in got if n[r.h] > 1)
    assert sum(r.maybe for r in got if n[r.h] == 1) < 200
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 1)
    monkeypatch.setattr(exact_dedup, "MIN_BITS", exact_dedup.SEGMENT_BITS)
    texts = [(i, f"text {i % 700}", "en", "a") for i in range(1000)]
    got = exact_dedup.exact_groups(wide(spark, texts)).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(i, i % 700) for i in range(1000)]


# ---- licence rules ---------------------------------------------------------

def test_every_known_sentence_has_a_cue():
    for text in license_rules.SENTENCES.values():
        assert any(c in text.lower() for c in license_rules.CUES), text


def test_licences(spark):
    s = license_rules.SENTENCES
    rows = [(1, "intro\n" + s["mit-grant"] + "\n" + s["mit-notice"] + "\n" + s["as-is"], "en", "a"),
            (2, s["mit-notice"] + "\n" + s["mit-grant"], "en", "a"),                 # wrong order: grant and notice do not make the long rule
            (3, "Some words. " + s["apache-named"].upper() + " More.\n" + s["cc-by-named"], "en", "a"),
            (4, s["bsd-grant"].replace(" permitted ", " permitted\n   ") + "  " + s["as-is"], "en", "a"),
            (5, "This mentions a license only.", "en", "a"), (6, None, "en", "a"), (7, "", "en", "a"),
            (8, s["mit-named"][:-1] + " " + "x " * 20_000, "en", "a")]
    got = {r.doc_id: r for r in license_rules.scan_licences(wide(spark, rows)).collect()}
    names = {k: [x.licence for x in r.licences] for k, r in got.items()}
    assert names == {1: ["MIT"], 2: [], 3: ["Apache-2.0", "CC-BY-4.0"], 4: ["BSD"], 5: [], 6: [], 7: [], 8: []}
    assert got[1].licences[0].rule == "mit-grant mit-notice as-is" and got[4].licences[0].rule == "bsd-grant as-is"
    assert got[3].sentences == ["apache-named", "cc-by-named"]
    assert license_rules.scan_licences(wide(spark, rows).limit(0)).count() == 0


MIT_FILE = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_HEADER = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL_NOTICE = """frob - a program to frob files
Copyright (C) 2020  Jane Doe

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_notices_as_they_stand_in_files(spark):
    """Wrapped, under lines without a full stop; as comments; with other line ends."""
    files = [MIT_FILE, APACHE_HEADER, GPL_NOTICE]
    comments = ["/*\n" + "".join(f" * {line}\n" for line in f.splitlines()) + " */\n" for f in files]
    tight = [f.replace("\n\n", "\n") for f in files]
    rows = [(i, f, "en", "a") for i, f in enumerate(files + comments + tight + [f.replace("\n", "\r\n") for f in files])]
    got = {r.doc_id: r for r in license_rules.scan_licences(wide(spark, rows)).collect()}
    want = [("MIT", "mit-grant mit-notice as-is"), ("Apache-2.0", "apache-notice apache-copy"), ("GPL-3.0", "gpl-grant gpl-warranty")]
    assert {i: [tuple(x) for x in r.licences] for i, r in got.items()} == {i: [want[i % 3]] for i in range(12)}
    assert all(" ".join(got[i].sentences) == want[i % 3][1] for i in got)


def test_notices_on_lines_and_in_paragraphs(spark):
    """What only lines show and what only sentence ends show are both kept, in text order."""
    rows = [(1, "Licence\nReleased under the MIT License.\nThe manual is ours. Licensed under CC BY 4.0. Thanks to all", "en", "a"),
            (2, "Ours. Licensed under CC BY 4.0. Thanks\nReleased under\nthe MIT License.\nLicence\nLicensed under CC BY 4.0\nThanks", "en", "a"),
            (3, license_rules.SENTENCES["mit-named"], "en", "a")]
    got = {r.doc_id: (r.sentences, [x.licence for x in r.licences]) for r in license_rules.scan_licences(wide(spark, rows)).collect()}
    assert got == {1: (["mit-named", "cc-by-named"], ["MIT", "CC-BY-4.0"]),
                   2: (["cc-by-named", "mit-named", "cc-by-named"], ["MIT", "CC-BY-4.0"]), 3: (["mit-named"], ["MIT"])}


# ---- quality rules ---------------------------------------------------------

def brute_counts(text):
    w = words(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n, cover = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_counts(spark):
    rows = ROWS + [(900, "a a a a a b b", "en", "a"), (901, "p q r p q r p q # | r\n\np q\np q", None, "a"), (902, "A 💡 é́ 漢字 ### <b>", "xx", "a")]
    got = quality_rules.judge(wide(spark, rows), labels(spark, [])).collect()
    have = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got)
    want = []
    for i, t, _, _ in rows:
        c = brute_counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((str(i), *c, failed, not failed))
    assert have == sorted(want)
    assert quality_rules.judge(wide(spark, EDGE).limit(0), labels(spark, [])).count() == 0


def test_partial_hashes_take_the_long_way(spark):
    """Both ways of finding equal windows agree."""
    texts = [(i, t) for i, t, _, _ in ROWS if t]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("words", F.split(F.btrim("text"), r"[\x20\x09-\x0D]+")) \
        .withColumn("n_words", F.size("words"))
    short = {(r.doc_id, r.text): r.n_repeat_words for r in quality_rules._repeat_words(df).collect()}
    kept = F.expr
    try:
        quality_rules.F.expr = lambda s: kept("cast(null as array<int>)") if s.startswith("if(array_contains(near") else kept(s)
        long = {(r.doc_id, r.text): r.n_repeat_words for r in quality_rules._repeat_words(df).collect()}
    finally:
        quality_rules.F.expr = kept
    assert short == long and any(short.values())


def test_binomial_tail(spark):
    cases = [(10, 0), (100, 0), (1000, 3), (5000, 20), (20000, 60), (300, 200)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.005).alias("p"))
    for r in df.collect():
        exact = 1.0 if r.k > r.n * 0.005 else sum(
            math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.005) + (r.n - i) * math.log(0.995))
            for i in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-6)


def test_cutoffs_are_certified(spark):
    """Enough clean labelled rows: junk is rejected, clean rows stay; too few: nothing is."""
    clean = [(i, " ".join(f"t{i}x{j}" for j in range(55)), "en", "a") for i in range(2500)]
    junk = [(10_000 + i, " ".join(f"t{i}x{j}###" for j in range(55)), "en", "a") for i in range(60)]
    marks = [(i, 1, 0) for i, *_ in clean] + [(i, 0, 0) for i, *_ in junk] + [(None, 1, 0), (3, None, 0)]
    prepare(spark)
    got = {r.doc_id: r.kept for r in quality_rules.judge(wide(spark, clean + junk), labels(spark, marks)).collect()}
    assert not any(got[i] for i, *_ in junk) and all(got[i] for i, *_ in clean)
    few = marks[:100] + marks[2500:2560]
    got = {r.doc_id: r.kept for r in quality_rules.judge(wide(spark, clean[:100] + junk), labels(spark, few)).collect()}
    assert all(got.values())


def test_level_counts_strata_exactly(spark):
    counts = spark.range(1200).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("stratum"))
    level = quality_rules.with_level(counts, counts)
    assert level.columns == ["stratum", "level"]
    assert {r.level for r in level.collect()} == {quality_rules.ERROR / (1200 * len(quality_rules.CUTOFFS))}
    assert quality_rules.with_level(counts.limit(0), counts.limit(0)).count() == 0
