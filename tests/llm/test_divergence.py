"""Source divergence against a brute-force version."""

import re
from collections import Counter, defaultdict

from tributary.llm import divergence
from tributary.llm.exact_dedup import member_bits

from helpers import EDGE, LOWER, real_rows, wide

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall((t or "").translate(LOWER))) for _, t, lang, source in rows]
    seen, out = Counter(), []
    for lang, _, terms in docs:
        seen.update((lang, t) for t in set(terms))
    kept = defaultdict(set)
    for (lang, t), n in seen.items():
        if n >= least:
            kept[lang].add(t)
    count = defaultdict(Counter)
    for lang, source, terms in docs:
        for key in ((lang, source), (lang,)):
            count[key].update(t for t in terms if t in kept[lang])

    def p(key, t):
        return 1 + 10 ** 9 * (count[key][t] + 1) // (sum(count[key].values()) + len(kept[key[0]]))

    def f(x, y):
        return (x - y) ** 2 // y

    groups = [k for k in count if len(k) == 2]
    shares = {k: {t: p(k, t) for t in kept[k[0]]} for k in count}
    for g in groups:
        pair = [(h[1], sum(f(shares[g][t], shares[h][t]) for t in kept[g[0]])) for h in groups if h[0] == g[0] and h != g]
        term = [(t, f(x, shares[g[:1]][t])) for t, x in shares[g].items() if count[g][t] > 0 and x > shares[g[:1]][t]]
        for part, items, most in (("pair", pair, None), ("term", term, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(*g, part, *x, k + 1) for k, x in enumerate(items[:most])]
    return sorted(out)


def run(spark, rows, **options):
    return sorted(map(tuple, divergence.divergence(wide(spark, rows), **options).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_against_brute_force(spark):
    rows = EDGE + real_rows()
    assert run(spark, rows) == brute(rows)


def test_many_buckets(spark, monkeypatch):
    """Counts dealt over many buckets are those of one."""
    monkeypatch.setattr(divergence, "BUCKET_TERMS", 40)
    rows = EDGE + real_rows()
    assert divergence.bucket_count(divergence.blocks(wide(spark, rows))) > 20
    assert run(spark, rows) == brute(rows)


def test_edge_rows_and_long_terms(spark):
    long = "漢" * 5000
    rows = EDGE + [(300 + k, f"{long}{'x' * (k % 2)} shared Term{k}", "zh", f"s{k % 3}") for k in range(8)] \
        + [(400, None, "xx", "only"), (401, "solitary words", "yy", "a"), (402, "solitary words", "yy", None)]
    want = brute(rows)
    assert any(r[3] == long for r in want) and ("yy", "a", "pair", "", 0, 1) in want
    assert run(spark, rows) == want


def test_ranks_stop_at_top(spark):
    rows = real_rows()
    assert run(spark, rows, least=2, top=5) == brute(rows, least=2, top=5)


def test_empty_table_and_no_terms(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "12 34", "en", "a")]) == []


def test_rare_prefixes_are_discarded_before_they_grow(spark):
    rows = [(k, f"common{'abcdefgh'[k]}tail rare{'abcdefgh'[k]}x", "en", "a") for k in range(8)] + [(9, "commonxx commonyy", "en", "a")]
    packed = divergence.blocks(wide(spark, rows))
    two = divergence.level(packed, 2, 0, None, 3)
    assert {r["prefix"]: r["n"] for r in two.collect()} == {b"co": 9, b"ra": 8}
    four = divergence.level(packed, 4, 2, member_bits(two, "h"), 3)
    assert {r["prefix"]: r["n"] for r in four.collect()} == {b"comm": 9, b"rare": 8}
    eight = divergence.level(packed, 8, 4, member_bits(four, "h"), 3)
    assert eight.collect() == []    # no prefix of eight bytes is in three documents
    assert divergence.kept_terms(packed).collect() == []
