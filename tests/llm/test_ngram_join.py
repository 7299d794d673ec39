"""The n-gram join (10) and connected components against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
from helpers import BASE, EDGE, real_rows, wide, words

from tributary.llm import common, components, exact_dedup, linking, ngram_join


def brute(rows):
    sets = []
    for _, t, *_ in rows:
        w = words(t, lower=True)
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
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
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                parent[find(j)] = find(k)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(str((i, len(sets[k]), least.get(find(k), i) if sets[k] else i)) for k, (i, *_) in enumerate(rows))


def run(spark, rows):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_join.near_groups(wide(spark, rows)).collect())


def near_rows():
    """Groups of near copies of every size, chains, shared passages."""
    rng, rows, k = random.Random(5), [], 0
    passage = [f"shared{i}" for i in range(60)]
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 25, 31, 40, 60, 90, 140, 300, 700]:
        for _ in range(3):
            base = [f"v{rng.randrange(10 ** 6)}" for _ in range(n)]
            if n % 3 == 0:
                base[n // 2:n // 2] = passage
            for _ in range(6):
                rows.append((1000 + k, " ".join(base), "en", "a"))
                k += 1
                for _ in range(max(1, len(base) // 60)):      # drift: neighbours link, ends need not
                    base[rng.randrange(len(base))] = f"e{rng.randrange(10 ** 6)}"
                if rng.random() < 0.4:
                    base.append("tail")
    return rows


def test_against_brute_force(spark):
    rows = EDGE + real_rows() + near_rows()
    assert run(spark, rows) == brute(rows)


def test_families_in_blocks(spark, monkeypatch):
    """Heavy keys and many blocks give the same groups."""
    monkeypatch.setattr(linking, "HEAVY", 2)
    monkeypatch.setattr(linking, "BLOCK_SETS", 16)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(90)]
    rows = near_rows()[:40]
    for i in range(40):     # near copies of one text, few of them near each other
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            w[rng.randrange(90)] = f"y{rng.randrange(10 ** 6)}"
        rows.append((5000 + i, " ".join(w), "en", "a"))
    assert run(spark, rows) == brute(rows)


def test_few_words_and_empty(spark):
    rows = [(1, "a b", "en", "a"), (2, "A  b", "en", "a"), (3, "b a", "en", "a"), (4, None, "en", "a"), (5, "", "en", "a"),
            (6, "a b c", "en", "a"), (None, "a b c", "en", "a"), (None, None, "en", "a")]
    assert run(spark, rows) == brute(rows)
    assert ngram_join.near_groups(wide(spark, rows).limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"u{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w), "en", "a"))
    assert run(spark, rows) == brute(rows)


def test_sparse_sets_share_a_key():
    """Linked sets share a key whatever their empty segments."""
    least, rng = ngram_join.bands(), np.random.default_rng(3)
    for n in [6, 7, 8, 9, 11, 13, 14, 20, 33, 64, 100, 250]:
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            most = 3 * (2 * n) // 37
            drop = int(rng.integers(0, most + 1))
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, most - drop + 1))).astype(np.uint64)]))
            common = len(np.intersect1d(x, y))
            if 100 * common < 85 * (len(x) + len(y) - common) or len(np.union1d(x, y)) == common:
                continue
            keys, per = ngram_join.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), least)
            assert np.intersect1d(keys[:per[0]], keys[per[0]:]).size > 0


def test_difference_bound():
    """The partition's H covers every pair of partner sizes."""
    least = ngram_join.bands()
    for band in range(40):
        h, r, m = ngram_join.partition(band, least)
        for a in {int(least[band]), int(least[band + 1]) - 1}:
            for b in range(a, a * 100 // 85 + 1):
                need = -(-85 * (a + b) // 185)
                assert a + b - 2 * need <= h and m == h + 1 + r
                assert np.searchsorted(least, b, side="right") - 1 <= band + 1


def test_hashes_of_sets():
    sets, bounds = ngram_join.shingle_sets(pa.array(["a b c d e", "A B C D E", None, "a", "a b c d a b c d", "d c b a e"]))
    prints = ngram_join.fingerprints(sets, bounds)
    assert np.diff(bounds).tolist() == [2, 2, 0, 1, 4, 2] and prints[0] == prints[1] != prints[5]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_components_stop_at_stars(spark, monkeypatch):
    """Stars take one round and one table; no round of a chain or of repeated
    and turned links leaves the links as they were."""
    tables = []

    def kept(df, name, **options):
        tables.append(common.written(df, name, **options))
        return tables[-1]

    monkeypatch.setattr(components, "written", kept)
    stars = [(10 * (k % 3), 100 + k) for k in range(40)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {(v, u) for u, v in stars} and len(tables) == 1
    for pairs in ([(i, i + 1) for i in range(70)], [(i * 37 % 71, (i + 1) * 37 % 71) for i in range(70)] * 2 + [(3, 3), (1, 0)]):
        tables.clear()
        got = {tuple(r) for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
        rounds = [sorted(t.collect()) for t in tables]
        assert got == {(i, 0) for i in range(1, 71)} and len(rounds[-1]) == 70
        assert all(a != b for a, b in zip(rounds, rounds[1:]))


def test_rounds_end(spark):
    """No copies, all copies, two copies, one row."""
    unlike = [(i, " ".join(f"d{i}w{j}" for j in range(40)), "en", "a") for i in range(6)]
    near = [(10, BASE, "en", "a"), (11, BASE + " more", "en", "a")]
    for rows in (unlike, [(i, BASE, "en", "a") for i in range(5)], near, near + unlike, unlike[:1]):
        assert run(spark, rows) == brute(rows)


def test_families_need_few_links(spark):
    """Keys with heads of their own give a link a node, not one a node and head."""
    from tributary.llm import linking
    rows = [(k, n) for k in range(30) for n in [k, *range(100, 160)]] + [(99, 500), (99, 501)]
    heavy = spark.createDataFrame(rows, "key long, node long")
    assert linking.family_links(heavy).count() < 130       # nodes and heads; 1,800 a node and head
    got = {r.node: r.g for r in linking.families(heavy).collect()}
    assert {n for n, g in got.items() if g == 0} == {*range(30), *range(100, 160)} and got[500] == got[501] == 500


def joined_rows(df):
    """Rows that the joins of a query make; a reused exchange counts once."""
    df.collect()

    def made(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return made(plan.executedPlan())
        if name.endswith("QueryStage"):
            return made(plan.plan())
        if name == "ReusedExchange":
            return 0
        own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return own + sum(made(plan.children().apply(i)) for i in range(plan.children().size()))

    return made(df._jdf.queryExecution().executedPlan())


def test_families_join_a_row_once(spark, monkeypatch):
    """A row of a heavy key (key, node) is joined to the key's head and to nothing else."""
    rows = [(k, n) for k in range(30) for n in [k, *range(100, 160)]] + [(99, 500), (99, 501)]
    made = []

    def counted(df, name):
        made.append(joined_rows(df))
        return common.written(df, name)

    monkeypatch.setattr(linking, "written", counted)
    made.append(joined_rows(linking.family_links(spark.createDataFrame(rows, "key long, node long"))))
    assert sum(made) == len(rows)


def test_families_of_any_keys(spark):
    """Nodes and keys in random order give the components of nodes and keys."""
    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.randrange(1000)) for _ in range(120)] + [(100 + k, 2000 + (k + d) % 40) for k in range(39) for d in range(2)]
    rows += rows[:10]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, n in rows:
        parent[find(("key", k))] = find(("node", n))
    least = {}
    for _, n in rows:
        least[find(("node", n))] = min(n, least.get(find(("node", n)), n))
    got = {r.node: r.g for r in linking.families(spark.createDataFrame(rows, "key long, node long")).collect()}
    assert got == {n: least[find(("node", n))] for _, n in rows}


def test_other_operators_caches_are_dropped(spark):
    """Python workers are reused: what the toxicity stage cached must not stay beside the next stages' data."""
    def fill(batches):
        yield from batches
        common.worker_store("toxicity")["cache"] = bytearray(1 << 20)

    def look(batches):
        import sys
        for _ in batches:
            pass
        stores = getattr(sys.modules.get("_tributary_worker"), "stores", {})
        yield pa.RecordBatch.from_arrays([pa.array([-1] * ("toxicity" in stores), pa.int64())], names=["id"])

    def held():
        return spark.range(0, 64, 1, 64).mapInArrow(look, "id long").filter("id < 0").count()

    docs = spark.createDataFrame([(i, f"{BASE} tail{i // 2}") for i in range(64)], "doc_id long, text string").repartition(64)
    for step in (ngram_join.near_groups, exact_dedup.exact_groups):
        spark.range(0, 64, 1, 64).mapInArrow(fill, "id long").count()
        assert held()
        assert step(docs).count() == 64
        assert not held()


def test_keys_are_handed_over_in_parts(monkeypatch):
    monkeypatch.setattr(ngram_join, "KEY_ROWS", 100)
    sizes = [0, 250, 3, 0, 1000, 0]
    keys = [np.arange(n, dtype="<i8") - 7 for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10, 16)), pa.array([k.tobytes() for k in keys], pa.binary())], names=["node", "keys"])
    got = list(ngram_join.key_rows(iter([batch.slice(0, 0), batch.slice(1), batch.slice(0, 1)])))
    assert max(b.num_rows for b in got) <= 100
    assert [r for b in got for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())] == \
        [(int(k), 10 + i) for i, x in enumerate(keys) for k in x]


def test_a_step_holds_no_freed_memory():
    import re
    from pathlib import Path

    def own():
        return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10

    pins = []

    def step(batches):
        held = [np.ones(12_000) for _ in range(2000)]     # 192 MB in pieces that the C library does not map one by one
        pins.append(np.ones(12_000))
        yield from batches
        del held

    common.worker_store("other")["held"] = 1
    before = own()
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    assert list(common.alone(step)(iter([batch]))) == [batch]
    assert own() - before < 60 and not common.worker_store("other")
