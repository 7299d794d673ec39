"""The pipeline's stages against what they must keep."""

import collections
import random

import corpus_pipeline
from helpers import EDGE, real_rows, wide, words
from test_ngram_join import brute, near_rows

from tributary.llm import mixing


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_dedup_stages(spark):
    rows = EDGE + real_rows()
    docs = wide(spark, rows)
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns
    import re
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = collections.Counter(min((x for x in g if x is not None), default=None) for g in groups.values())
    assert ids(kept) == want
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    least = collections.Counter(eval(x)[2] for x in set(brute(rows)))
    assert near.columns == docs.columns and set(ids(near)) == set(least) and max(ids(near)[i] for i in least if i is not None) == 1


def test_near_copies_by_five_words(spark):
    """Jaccard similarity of 0.8 or more over five-word shingles, whatever op10's rule says."""
    rng, rows = random.Random(9), [*EDGE, *real_rows(), *near_rows()]
    for k, (n, more) in enumerate([(104, 20), (104, 25), (104, 26), (204, 40), (204, 50), (204, 51), (404, 90), (404, 100), (404, 101)]):
        base = [f"p{k}x{rng.randrange(10 ** 6)}" for _ in range(n)]
        rows += [(9000 + 2 * k, " ".join(base), "en", "a"), (9001 + 2 * k, " ".join(base + [f"q{k}x{i}" for i in range(more)]), "en", "a")]
    sets = []
    for _, t, *_ in rows:
        w = words(t, lower=True)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = collections.defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        least[root[k]].append((i is None, i or 0))
    want = collections.Counter(None if none else i for none, i in map(min, least.values()))
    assert want[9001] == want[9003] == 0 and want[9005] == 1
    assert ids(corpus_pipeline.drop_near_copies(spark, wide(spark, rows), "")) == want


def test_mix_stage(spark):
    rows = EDGE + real_rows()
    docs = wide(spark, rows)
    out = corpus_pipeline.mix_sources(spark, docs, "")
    want = collections.Counter()
    for r in mixing.taken(docs).collect():
        if r.taken:
            want[r.doc_id] += -(-r.taken // r["size"])
    assert out.columns == docs.columns and ids(out) == want


def test_empty(spark):
    none = wide(spark, EDGE).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0, name


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert got and all(0 <= r.offset and r.offset + r.length <= 4096 for r in got)
    used = collections.Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096
