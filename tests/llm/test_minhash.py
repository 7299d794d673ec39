"""MinHash near-duplicates against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
from helpers import BASE, EDGE, real_rows, wide, words
from test_ngram_join import near_rows

from tributary.llm import linking, minhash
from tributary.llm.ngram_join import shingle_sets


def brute(rows):
    sets = []
    for _, t, *_ in rows:
        w = words(t, lower=True)
        sets.append({tuple(w[i:i + 2]) for i in range(len(w) - 1)} if len(w) >= 2 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    for k, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in by[x] if j > k)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(j)] = find(k)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    out = []
    for k, (i, *_) in enumerate(rows):
        c = least.get(find(k), i) if sets[k] else i
        out.append(str((i, len(sets[k]), c, i == c)))
    return sorted(out)


def run(spark, rows):
    return sorted(str(tuple(r)) for r in minhash.near_groups(wide(spark, rows)).collect())


def test_against_brute_force(spark):
    rows = EDGE + real_rows() + near_rows()
    assert run(spark, rows) == brute(rows)


def test_large_group_and_families(spark, monkeypatch):
    """A group of near copies and copies too far from each other, in blocks."""
    monkeypatch.setattr(linking, "HEAVY", 2)
    monkeypatch.setattr(linking, "BLOCK_SETS", 16)
    rng = random.Random(4)
    base, rows = [f"b{i}" for i in range(90)], []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 6, 9, 14])):
            w[rng.randrange(90)] = f"y{rng.randrange(10 ** 6)}"
        rows.append((5000 + i, " ".join(w), "en", "a"))
    assert run(spark, rows) == brute(rows)


def test_edge_tables(spark):
    unlike = [(i, " ".join(f"d{i}w{j}" for j in range(40)), "en", "a") for i in range(5)]
    few = [(1, "a", "en", "a"), (2, "A ", "en", "a"), (3, "a b", "en", "a"), (4, None, "en", "a"), (5, "", "en", "a"), (None, "a", "en", "a"),
           (None, None, "en", "a"), (None, "only null ids", "en", "a"), (None, "only null ids", "en", "a")]
    for rows in (unlike[:1] + few, [(i, BASE, "en", "a") for i in range(5)] + unlike):
        assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    functions = minhash.hash_functions()
    for share in (0.5, 0.8, 0.95):
        n = 40_000      # more than one step
        common = rng.integers(0, 1 << 63, int(n * share)).astype(np.uint64)
        sets = [np.concatenate([common, rng.integers(0, 1 << 63, (n - len(common)) // 2).astype(np.uint64)]) for _ in range(2)]
        low = minhash.minima(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), functions)
        a, b = functions
        assert (low[0] == np.array([int((sets[0].size and (mixed(sets[0]) * x + y)).min() >> np.uint64(32)) for x, y in zip(a, b)])).all()
        assert abs((low[0] == low[1]).mean() - share) < 5 * (share * (1 - share) / minhash.HASHES) ** 0.5


def mixed(x):
    return minhash.mix(x + np.uint64(0x3C6EF372FE94F82B))


def test_empty_sets_between_others():
    sets, bounds = shingle_sets(pa.array([None, "a b c", "", "d e f", "a b c", None]), minhash.RULE)
    low = minhash.minima(sets, bounds, minhash.hash_functions())
    assert (low[1] == low[4]).all() and (low[1] != low[3]).mean() > 0.9 and (low[0] == 0xFFFFFFFF).all()
    assert (minhash.band_keys(low)[1] == minhash.band_keys(low)[4]).all()
