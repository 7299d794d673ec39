"""Language (2), language model (5) and toxicity (9)."""

import base64
import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import EDGE, SF, real_rows, wide, words
from pyspark.sql import functions as F

from tributary.llm import attention_lm, language, toxicity
from tributary.llm.common import fold_crc, prepare
from tributary.llm.queries import QUERIES
from tributary.llm.words import WordTable, coded_words

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_coded_words():
    texts = [t for _, t, *_ in EDGE]
    names, codes, bounds = coded_words(pa.array(texts))
    names = names.to_pylist()
    assert [[names[c] for c in codes[a:b]] for a, b in zip(bounds[:-1], bounds[1:])] == [words(t, lower=True) for t in texts]
    part, codes, bounds = coded_words(pa.array(["é à ü"] * 3 + texts * 40).slice(5, 60))
    part = part.to_pylist()
    assert [[part[c] for c in codes[a:b]] for a, b in zip(bounds[:-1], bounds[1:])] == [words(t, lower=True) for t in (texts * 40)[2:62]]


# ---- language --------------------------------------------------------------

def test_held_out_accuracy(spark):
    got = QUERIES["op2_language"](spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_spans_edges_and_scripts(spark):
    prepare(spark)
    train = [(t, l, i) for i, t, l, _ in real_rows()] + [("это русский текст и много слов " * 9 + str(i), "ru", i) for i in range(20)] \
        + [("αυτό είναι κείμενο στα ελληνικά " * 9 + str(i), "el", i) for i in range(20)]
    model = language.fit(spark.createDataFrame(train, "text string, lang string, order long"))
    english = next(t for _, t, l, _ in real_rows() if l == "en" and len(t) > 800)
    german = next(t for _, t, l, _ in real_rows() if l == "de" and len(t) > 800)
    mixed = " ".join(words(english)[:60] + words(german)[:30] + "это русский текст и много слов".split() * 3)
    rows = [(1, mixed, None, None), (2, None, None, None), (3, " 12 -- !", None, None), (4, "слов", None, None), (5, "漢字", None, None),
            (6, english * 20, None, None), (None, german, None, None)]
    got = {r.doc_id: r for r in language.predict(wide(spark, rows), model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de", "ru"] and got[1].lang_pred == "en" and got[1].score < 0.8
    assert abs(got[1].spans[1].first_word - 60) <= 3 and sum(s.n_words for s in got[1].spans) == len(words(mixed))
    assert [got[i].lang_pred for i in (2, 3, 4, 6, None)] == ["und", "und", "ru", "en", "de"]
    assert got[2].score == got[3].score == got[5].score == 0 and got[5].lang_pred == model.languages[model.common]
    assert language.predict(wide(spark, rows).limit(0), model).count() == 0
    none = language.fit(spark.createDataFrame([], "text string, lang string, order long"))
    assert {r.lang_pred for r in language.predict(wide(spark, rows), none).collect()} == {"und"}


def test_viterbi_and_one_span():
    """The decoder finds the best path; the one-span test never claims wrongly."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, k = int(rng.integers(1, 7)), 3
        s = rng.normal(0, 4, (n, k))
        penalty = 5.0

        def value(path):
            return sum(s[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))

        every = max(value(p) for p in np.ndindex(*(k,) * n))
        assert value(language.decode(s, penalty).tolist()) == pytest.approx(every)
        best, single = language.one_span(s, np.array([0, n]), penalty)
        if single[0]:
            assert value([int(best[0])] * n) == pytest.approx(every)


def test_one_span_with_extreme_sums():
    """Sums too large for one prefix sum over all texts never hide a span inside a text."""
    own, other = [9.0, 0.0], [0.0, 9.0]
    scores = np.array([own] * 50 + [other] * 20 + [own] * 50 + [own] * 40 + [[1e13, 0.0]])
    bounds = np.array([0, 120, 160, 161])
    best, single = language.one_span(scores, bounds)
    assert best.tolist() == [0, 0, 0] and single.tolist() == [False, True, True]
    assert set(language.decode(scores[:120]).tolist()) == {0, 1}


# ---- language model --------------------------------------------------------

def test_base_scores(spark):
    rows = EDGE + real_rows()
    held_by = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    held = F.coalesce(fold_crc(5) == 1, F.lit(False))
    got = attention_lm.score_documents(wide(spark, rows), held, PATH, 49407).collect()
    count = collections.Counter(w for i, t, *_ in rows if not held_by(i) for w in words(t, lower=True) + ["\n"])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t, *_ in rows:
        w = words(t, lower=True) + ["\n"]
        want.append((str(i), held_by(i), len(w), sum(count[x] > 0 for x in w), n,
                     sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    have = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    for a, b in zip(have, sorted(want, key=str)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert attention_lm.score_documents(wide(spark, EDGE).limit(0), held, PATH, 49407).count() == 0


def test_packed_numbers():
    for kind in ("u1", "<u2", "<u4", "<i8"):
        for n in (0, 1, 1000):
            x = np.random.default_rng(n).integers(0, np.iinfo(kind).max, n).astype(kind)
            assert (attention_lm.unpacked(attention_lm.packed(x), kind) == x).all()
    codes = np.array([0, 3, 70000, 70001])
    assert (attention_lm.ascending(attention_lm.packed(np.diff(codes, prepend=0).astype("<u4"))) == codes).all()


def test_many_buckets_of_words(spark, monkeypatch):
    """Words dealt over many buckets give the scores of one."""
    rows, held = real_rows(), F.col("doc_id") % 5 == 1
    keep = lambda: sorted(attention_lm.score_documents(wide(spark, rows), held, PATH, 49407)
                          .select("doc_id", "n_known", "train_tokens", "base_score", "score").collect())
    one = keep()
    monkeypatch.setattr(attention_lm, "BUCKET_WORDS", 100)
    for a, b in zip(one, keep(), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-5)


def test_word_of_many_ids(spark):
    """One unbroken word of over 65,536 ids is scored like any text, and so are its neighbours."""
    held = F.coalesce(fold_crc(5) == 1, F.lit(False))
    long = base64.b64encode(np.random.default_rng(1).bytes(112_500)).decode()
    few = real_rows()[:40]
    assert len(attention_lm.encoder(PATH).encode_distinct([long.lower()])[0]) > 1 << 16
    plain = {r.doc_id: r.score for r in attention_lm.score_documents(wide(spark, few).coalesce(1), held, PATH, 49407).collect()}
    heldout = next(i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 5 == 1)    # does not train
    got = {r.doc_id: r.score for r in attention_lm.score_documents(
        wide(spark, [*few, (heldout, f"{few[0][1]} {long}", "en", "a")]).coalesce(1), held, PATH, 49407).collect()}
    long_score = got.pop(heldout)
    assert got == pytest.approx(plain, abs=1e-3) and -10 * 150_000 < long_score < got[few[0][0]] - 65_536


def test_counts_cover_all_pairs(spark, monkeypatch):
    """With fewer model ids than the corpus has pairs, no pair inside a word is lost."""
    monkeypatch.setattr(attention_lm, "IDS", 12)
    seen = {}
    fit_counts = attention_lm.fit_counts
    monkeypatch.setattr(attention_lm, "fit_counts", lambda *a, **k: seen.update(a=a, model=fit_counts(*a, **k)) or seen["model"])
    rows = EDGE + real_rows()
    attention_lm.score_documents(wide(spark, rows), F.lit(False), PATH, 49407).count()
    words_of = collections.Counter(w for _, t, *_ in rows for w in words(t, lower=True))
    ids, lens = attention_lm.encoder(PATH).encode_distinct(list(words_of))
    n = np.array(list(words_of.values()))
    count = np.bincount(ids, np.repeat(n, lens), attention_lm.vocabulary_size(PATH))
    number, got, inner = seen["a"][:3]
    count[49407] = got[49407]
    assert (got == count).all() and (number == attention_lm.model_numbers(count, 49407)).all()
    want, size = collections.Counter(), int(number[-1]) + 1
    for k, x in zip(n, np.split(ids, np.cumsum(lens)[:-1])):
        m = [size, *number[x], size] if len(x) else []
        for pair in zip(m[:-1], m[1:]):
            want[pair] += k
    assert size == 12 and {(i // (size + 1), i % (size + 1)): x for i, x in enumerate(inner.tolist()) if x} == want


def test_transitions_between_words_cover_all_texts(spark, monkeypatch):
    """Pairs between words and ends are the corpus's, whatever the sample."""
    monkeypatch.setattr(attention_lm, "TRAIN_DOCS", 3)
    monkeypatch.setattr(attention_lm, "IDS", 200)
    seen = {}
    fit_counts = attention_lm.fit_counts
    monkeypatch.setattr(attention_lm, "fit_counts", lambda *a, **k: seen.update(a=a, model=fit_counts(*a, **k)) or seen["model"])
    rows = EDGE + real_rows()
    held = F.coalesce(fold_crc(5) == 1, F.lit(False))
    attention_lm.score_documents(wide(spark, rows), held, PATH, 49407).count()
    number, count, _, cross, ends, sample = seen["a"]
    encode = attention_lm.encoder(PATH).encode_distinct
    own, want, texts = {}, collections.Counter(), 0
    for i, t, *_ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 1:
            continue
        texts += 1
        before = int(number[-1])
        for w in words(t, lower=True):
            if w not in own:
                own[w] = number[encode([w])[0]]
            if len(own[w]):
                want[before, int(own[w][0])] += 1
                before = int(own[w][-1])
        want[before, int(number[-1])] += 1
    assert len(sample) < 30 < texts == ends == count[49407]
    assert {(int(a), int(b)): cross[a, b] for a, b in zip(*np.nonzero(cross))} == want


def test_head_learns_from_every_training_text(spark, monkeypatch):
    """Each window of each training text is in one round; a text beyond any sample moves the weights, a held-out one does not."""
    lengths = np.array([1, 16, 17, 50])
    model, _ = tiny_model(0)
    ids = np.random.default_rng(2).integers(1, 20, lengths.sum()).astype(np.int32)
    seen = []
    monkeypatch.setattr(attention_lm.Adam, "step", lambda self, x, y, inside, pace: seen.append(y[inside]))
    assert sum(attention_lm.train_shard(model, ids, lengths, turn, 3) for turn in range(3)) == 1 + 1 + 2 + 4
    assert sorted(np.concatenate(seen).tolist()) == sorted(ids.tolist())
    monkeypatch.undo()

    def weights(texts, held):
        rows = [(k, list(range(k * 40, k * 40 + 40)), held, attention_lm.packed(np.full(40, 30, "<i8")), attention_lm.packed(x)) for k, x in enumerate(texts)]
        model, _ = tiny_model(0)
        attention_lm.train_corpus(model, spark.createDataFrame(rows, "block long, doc_id array<long>, held array<boolean>, lengths binary, ids binary"))
        return np.concatenate([getattr(model, f).reshape(-1) for f in attention_lm.Adam.HEAD])

    texts = [np.random.default_rng(k).integers(1, 20, 1200).astype("<u2") for k in range(50)]      # 2,000 texts
    held = [k == 39 for k in range(40)]
    base = weights(texts, held)
    for k in (7, 49):
        other = [x.copy() for x in texts]
        other[k][-30:] = 1
        assert (weights(other, held) == base).all()
        other[k][:30] = 1
        assert (weights(other, held) != base).any()


def test_beats_word_counts_on_held_out_texts(spark):
    got = [r for r in QUERIES["op5_attention_lm"](spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert len(got) > 1500 and sum(r.score for r in got) > 0.99 * sum(r.base_score for r in got)


def tiny_model(steps):
    rng = np.random.default_rng(0)
    texts = [np.concatenate([rng.integers(2, 20, 30), np.full(10, 2 + k % 18), [21]]) for k in range(80)]
    flat = np.concatenate(texts)
    pair, n = np.unique((flat[:-1].astype(np.uint64) << np.uint64(32)) | flat[1:].astype(np.uint64), return_counts=True)
    edge = (np.arange(2, 20).astype(np.uint64) << np.uint64(32)) | np.uint64(0xFFFFFFFF)
    start = (np.uint64(0xFFFFFFFF) << np.uint64(32)) | np.arange(2, 20).astype(np.uint64)
    pairs = np.concatenate([pair, edge, start]).view(np.int64)
    return attention_lm.fit([pairs, np.concatenate([n, np.full(36, 20)])], texts, 30, 21, steps), texts


def test_probabilities_sum_to_one_and_training_helps():
    """Over every next id, the vocabulary's probabilities sum to one; Adam raises the likelihood."""
    model, texts = tiny_model(60)
    x = model.number[texts[0][:attention_lm.WINDOW]][None, :]
    total = np.zeros(attention_lm.WINDOW)
    for t in range(len(model.u)):
        total += 10.0 ** model.log10(x, np.full_like(x, t), 0)
    assert total == pytest.approx(np.ones(attention_lm.WINDOW), abs=1e-4)
    assert (10.0 ** model.spread[model.number[:-1] == 0]).sum() == pytest.approx(1.0)
    plain, _ = tiny_model(0)
    ids, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    assert attention_lm.score(model, model.number[ids], lengths).sum() > attention_lm.score(plain, plain.number[ids], lengths).sum()


def plain_gradient(model, x, y, inside):
    """What a step needs, written out place by place of the formulas."""
    n = x.shape[1]
    lag = np.arange(n)[:, None] - np.arange(n)[None, :]
    mask = np.where(lag >= 0, model.bias[np.clip(lag, 0, len(model.bias) - 1)], np.float32(-1e9)).astype(np.float32)
    weight = np.exp(np.clip(np.matmul(model.q[x], model.k[x].transpose(0, 2, 1)) + mask, None, 30.0))
    weight /= weight.sum(axis=2, keepdims=True)
    a = np.matmul(weight, model.v[x])
    dz = np.exp(a @ model.w) * model.s[x]
    dz /= -dz.sum(axis=2, keepdims=True)
    dz.reshape(-1, dz.shape[2])[np.arange(y.size), model.cls[y].reshape(-1)] += 1.0
    dz *= inside[:, :, None]
    dz /= np.float32(inside.sum())
    da = dz @ model.w.T
    dscore = np.matmul(da, model.v[x].transpose(0, 2, 1))
    dscore -= (dscore * weight).sum(axis=2, keepdims=True)
    dscore *= weight
    rows = np.concatenate([np.matmul(dscore, model.k[x]), np.matmul(dscore.transpose(0, 2, 1), model.q[x]),
                           np.matmul(weight.transpose(0, 2, 1), da)], axis=2).reshape(x.size, -1)
    at = x.reshape(-1)
    order = np.argsort(at, kind="stable")
    heads = np.flatnonzero(np.diff(at[order], prepend=-1))
    sums = np.zeros((len(model.q), rows.shape[1]), np.float32)
    sums[at[order][heads]] = np.add.reduceat(rows[order], heads, axis=0)
    width = attention_lm.WIDTH
    return {"q": sums[:, :width], "k": sums[:, width:2 * width], "v": sums[:, 2 * width:], "w": a.reshape(-1, width).T @ dz.reshape(-1, dz.shape[2]),
            "bias": np.bincount(np.clip(lag, 0, None).reshape(-1), dscore.sum(axis=0).reshape(-1), attention_lm.WINDOW)}


def test_gradient_is_right_and_cheap():
    """The same numbers as the plain formulas, for less CPU."""
    import time

    rng, size = np.random.default_rng(3), 2048
    normal = lambda *shape: (0.3 * rng.standard_normal(shape)).astype(np.float32)
    model = attention_lm.Model(number=np.arange(size + 1), spread=None, u=None, s=rng.random((size, 32)).astype(np.float32), cls=rng.integers(0, 32, size),
                               q=normal(size, 8), k=normal(size, 8), v=normal(size, 8), w=normal(8, 32), bias=normal(16))
    x, y = (rng.integers(0, size, (512, 16)).astype(np.int32) for _ in range(2))
    inside = rng.random((512, 16)) < 0.9
    adam = attention_lm.Adam(model)
    want, got = plain_gradient(model, x, y, inside), adam.gradient(x, y, inside)
    assert set(got) == set(want)
    for f in want:
        np.testing.assert_allclose(got[f], want[f], rtol=1e-3, atol=1e-6)

    def least(run):
        out = []
        for _ in range(40):
            began = time.thread_time()
            run()
            out.append(time.thread_time() - began)
        return min(out)

    assert least(lambda: adam.gradient(x, y, inside)) < 0.9 * least(lambda: plain_gradient(model, x, y, inside))


def test_windows_score_each_id_once():
    """Window by window equals one id at a time with the same context."""
    model, _ = tiny_model(20)
    rng = np.random.default_rng(3)
    for n in (1, 2, 15, 16, 17, 28, 29, 100):
        ids = np.concatenate([model.number[rng.integers(2, 20, n - 1)], [model.number[-1]]])
        before = np.concatenate([[model.number[-1]], ids[:-1]])
        _, start, first = attention_lm.windows(np.array([n]))
        want = 0.0
        for i in range(n):
            a = max(s for s, f in zip(start, first) if s + f <= i)
            want += model.log10(before[None, a:i + 1], ids[None, a:i + 1], i - a)[0]
        assert attention_lm.score(model, ids, np.array([n]))[0] == pytest.approx(want, abs=1e-3)


# ---- toxicity --------------------------------------------------------------

def test_toxic_accuracy(spark):
    root = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, root).collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    held = [i for i in marks if got[i].held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert np.mean([got[i].predicted for i in held if not marks[i]]) < 0.02
    assert np.mean([got[i].predicted for i in held if marks[i]]) > 0.7


def test_edges(spark):
    prepare(spark)
    rows = [(i, f"clean words here number{i} " + ("vile insult" if i % 4 == 0 else "plain talk"), "en", "a") for i in range(200)]
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(150)] + [(None, 1, 1), (3, 1, None), (0, 1, 0)],
                                  "doc_id long, quality int, toxic int")
    docs = wide(spark, rows + [(500, None, "en", "a"), (501, "", "en", "a"), (502, "VILE!! Insult, " * 5000, "en", "a"), (None, "vile insult", "en", "a")])
    model = toxicity.fit(toxicity.labelled(docs, marks, F.lit(True)))
    got = {r.doc_id: r for r in toxicity.score_texts(docs, *model).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(200))
    assert got[500].score == got[501].score < 0.5 <= got[502].score and got[None].score >= 0.5
    assert got[500].evidence == [] and all(e.toxic == 1 for e in got[502].evidence) and len(got[502].evidence) == toxicity.NEIGHBOURS
    kept = toxicity.keep_clean(docs, *model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in [*[i for i in range(200) if i % 4], 500, 501])
    empty = toxicity.fit(toxicity.labelled(docs, marks.limit(0), F.lit(True)))
    assert {r.score for r in toxicity.score_texts(docs, *empty).collect()} == {0.0}
    assert toxicity.score_texts(docs.limit(0), *model).count() == 0


def test_nearest_is_exact():
    """Block-max search equals the full scan."""
    rng = np.random.default_rng(8)
    terms = [f"t{i}" for i in range(40)]
    examples = [(i, int(rng.integers(2)), sorted(rng.choice(40, int(rng.integers(1, 6)), replace=False).tolist()), None) for i in range(900)]
    examples = [(i, y, t, rng.integers(1, 5, len(t)).tolist()) for i, y, t, _ in examples]
    index = toxicity.Index(terms, rng.integers(5, 300, 40).tolist(), 1000, examples, 0.3)
    dense = np.zeros((900, 40))
    for k, (t, w) in enumerate(index.vectors):
        dense[k, t] = w
    for _ in range(80):
        t = np.sort(rng.choice(40, int(rng.integers(1, 5)), replace=False))
        t, w = index.vector(t, rng.integers(1, 4, len(t)))
        cosine = dense[:, t] @ w
        want = [k for k in np.lexsort((np.arange(900), -np.round(cosine, 12)))[:toxicity.NEIGHBOURS] if cosine[k] > 0]
        found, near = index.nearest(t, w)
        assert found.tolist() == want and near == pytest.approx(cosine[want])


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert y == [0.0, 0.5, 1.0] and x == [1.0, 2.5, 4.0]


def test_word_table_clears():
    t = WordTable(lambda ws: np.array([[len(w)] for w in ws]), 1, np.int64, capacity=10)
    for _ in range(3):
        assert t.lookup([f"{'a' * i}" for i in range(1, 9)])[:, 0].tolist() == list(range(1, 9))
        assert t.lookup(["zz", "zzz"])[:, 0].tolist() == [2, 3]
