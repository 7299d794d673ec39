"""Toxicity by the nearest labelled examples.

Terms are words and word beginnings whose document frequency differs between
toxic and clean examples (log-likelihood ratio at least ``MIN_G2``).  Examples
and texts are TF-IDF vectors over these terms, of length one.  A text's
``NEIGHBOURS`` nearest examples by cosine are found exactly with a block-max
inverted index: examples lie in blocks, every term keeps its largest weight
per block, blocks are visited by falling upper bound, and the search ends when
no block can still enter the result.  Neighbours vote with the square of the
cosine; votes are calibrated by isotonic regression on leave-one-out votes of
the examples.  Evidence are the neighbours with cosine and label.

The index is fitted on at most about ``TRAIN_ROWS`` labelled rows (chosen by
hash) and ``MAX_TERMS`` terms, so the model that is broadcast is bounded.

Rows: a text without any term (null and empty ones too) has the calibrated
score of such examples; without labels every score is 0; of several labels of
a document toxic counts, null labels are ignored; repeated rows get equal
results; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_store, written
from .words import WordTable, coded_words, doc_of, text_slices

TRAIN_ROWS = 12_000
MAX_TERMS = 4096
MIN_G2 = 30.0
MIN_DOCS = 5
PREFIXES = (4, 5, 6, 7)
NEIGHBOURS = 15
BLOCK = 64
PRIOR_WEIGHT = 0.5
SLICE_BYTES = 2 << 20   # text whose terms are counted at a time


def word_terms(word: str) -> list[str]:
    """The bare word in lower case and its beginnings."""
    w = word.lower()
    if not w.isalnum():
        inner = [i for i, c in enumerate(w) if c.isalnum()]
        if not inner:
            return []
        w = w[inner[0]:inner[-1] + 1]
    return [w] + [f"^{w[:n]}" for n in PREFIXES if len(w) > n]


class Index:
    """Examples as TF-IDF vectors in a block-max inverted index."""

    def __init__(self, terms: list[str], df: list[int], rows: int, examples: list[tuple], prior: float):
        self.state = (terms, df, rows, examples, prior)     # plain values: what is broadcast
        self.slot = {t: i for i, t in enumerate(terms)}
        self.idf = np.log((1.0 + rows) / (1.0 + np.array(df, float))) + 1.0 if terms else np.zeros(0)
        self.prior = prior
        vectors = [(e, *self.vector(np.array(e[2]), np.array(e[3]))) for e in examples]
        # neighbours in order of their heaviest terms share blocks
        vectors.sort(key=lambda v: (int(v[1][np.argmax(v[2])]), -float(v[2].max()), v[0][0] is None, v[0][0] or 0))
        self.ids = [v[0][0] for v in vectors]
        self.toxic = np.array([v[0][1] for v in vectors], float)
        self.vectors = [v[1:] for v in vectors]
        n, t = len(vectors), max(1, len(terms))
        self.blocks = max(1, -(-n // BLOCK))
        lengths = [len(v[1]) for v in vectors]
        example = np.repeat(np.arange(n), lengths).astype(np.int64)
        term = np.concatenate([v[1] for v in vectors]).astype(np.int64) if n else np.zeros(0, np.int64)
        weight = np.concatenate([v[2] for v in vectors]) if n else np.zeros(0)
        order = np.lexsort((example, term))
        self.post_example, self.post_weight = example[order], weight[order]
        cell = term[order] * self.blocks + self.post_example // BLOCK
        self.start = np.searchsorted(cell, np.arange(t * self.blocks + 1)).reshape(-1)
        self.top = np.zeros(t * self.blocks)
        np.maximum.at(self.top, cell, self.post_weight)
        self.top = self.top.reshape(t, self.blocks)

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1.0 + np.log(tf)) * self.idf[terms]
        return terms, w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, skip: int = -1):
        """Exact k nearest examples: numbers and cosines, best first (ties by
        number).  Blocks are scored by falling bound, ever more at a time."""
        bound = weights @ self.top[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, cosine, least, first, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 2
        while first < len(order) and (len(found) < k or bound[order[first]] >= least):
            batch = order[first:first + step]
            if len(found) >= k:
                batch = batch[bound[batch] >= least]
            first, step = first + step, 2 * step
            cell = (terms[:, None].astype(np.int64) * self.blocks + batch).reshape(-1)
            size = self.start[cell + 1] - self.start[cell]
            at = np.repeat(self.start[cell] - np.cumsum(size) + size, size) + np.arange(size.sum())
            local = np.repeat(np.tile(np.arange(len(batch)) * BLOCK - batch * BLOCK, len(terms)), size) + self.post_example[at]
            score = np.bincount(local, self.post_weight[at] * np.repeat(np.repeat(weights, len(batch)), size), len(batch) * BLOCK)
            hit = np.flatnonzero(score > 0)
            number = batch[hit // BLOCK] * BLOCK + hit % BLOCK
            use = number != skip
            found, cosine = np.concatenate([found, number[use]]), np.concatenate([cosine, score[hit[use]]])
            best = np.lexsort((found, -np.round(cosine, 12)))[:k]
            found, cosine = found[best], cosine[best]
            if len(found) >= k:
                least = cosine[-1] - 1e-9
        return found, cosine

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine ** 2
        return float((w @ self.toxic[found] + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT))

    def text_vectors(self, table: WordTable, texts: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Vectors of the texts that have a term."""
        names, codes, bounds = coded_words(texts)
        if not len(names) or not self.slot:
            return {}
        rows = table.lookup(names.to_pylist())
        at = np.flatnonzero((rows[:, 0] >= 0)[codes])
        if not len(at):
            return {}
        doc = np.searchsorted(bounds, at, side="right") - 1
        terms = rows[codes[at]]
        some = terms >= 0
        key, tf = np.unique((doc[:, None] * len(self.slot) + terms)[some], return_counts=True)
        doc, term = key // len(self.slot), key % len(self.slot)
        cuts = np.flatnonzero(np.diff(doc)) + 1
        return {int(d[0]): self.vector(t, f) for d, t, f in zip(np.split(doc, cuts), np.split(term, cuts), np.split(tf, cuts))}

    def known_terms(self, words: list[str]) -> np.ndarray:
        """Numbers of each word's terms, known ones first, then -1."""
        out = np.full((len(words), 1 + len(PREFIXES)), -1, np.int32)
        get = self.slot.get
        for k, w in enumerate(words):
            ids = [i for i in map(get, word_terms(w)) if i is not None]
            out[k, :len(ids)] = ids
        return out

    def table(self) -> WordTable:
        return WordTable(self.known_terms, 1 + len(PREFIXES), np.int32)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: points (x, fitted y) of a rising step function."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        pools.append([b * w, w, a * w])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return [p[2] / p[1] for p in pools], [p[0] / p[1] for p in pools]


def _examples(sample: DataFrame, terms: list[str]) -> list[tuple]:
    """(doc_id, toxic, term numbers, counts) of the sample's rows with a term;
    at most the sample's rows."""
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("toxicity")
        index = Index(terms, [0] * len(terms), 1, [], 0.0)
        table = index.table()
        for b in batches:
            names, codes, bounds = coded_words(b.column(2))
            rows = table.lookup(names.to_pylist()) if len(names) else np.zeros((0, 1), np.int32)
            out = []
            for d, (x, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                t = rows[codes[bounds[d]:bounds[d + 1]]]
                ids, tf = np.unique(t[t >= 0], return_counts=True)
                if len(ids):
                    out.append((x, y, ids.tolist(), tf.tolist()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()),
                     pa.array([r[2] for r in out], pa.list_(pa.int32())), pa.array([r[3] for r in out], pa.list_(pa.int32()))],
                    names=["doc_id", "toxic", "terms", "tf"])

    got = sample.mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, tf array<int>").collect()
    return sorted(((r[0], r[1], list(r[2]), list(r[3])) for r in got), key=lambda r: (r[0] is None, r[0], r[2], r[3], r[1]))


def _term_counts(sample: DataFrame) -> DataFrame:
    """term, n0, n1: clean and toxic examples that have it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("toxicity")
        for b in batches:
            for i, j in text_slices(b.column(2), SLICE_BYTES):
                yield slice_counts(b.column(2).slice(i, j - i), np.array(b.column(1).slice(i, j - i).to_pylist(), np.int64))

    def slice_counts(texts: pa.Array, toxic: np.ndarray) -> pa.RecordBatch:
        names, codes, bounds = coded_words(texts)
        numbers: dict[str, int] = {}
        lists = [[numbers.setdefault(t, len(numbers)) for t in word_terms(w)] for w in names.to_pylist()]
        rows = np.full((len(lists), 1 + len(PREFIXES)), -1, np.int32)
        for k, x in enumerate(lists):
            rows[k, :len(x)] = x
        n = max(1, len(numbers))
        pair = np.unique(doc_of(bounds) * len(names) + codes)
        doc, terms = pair // max(1, len(names)), rows[pair % max(1, len(names))]
        some = terms >= 0
        key = np.unique((doc[:, None] * n + terms)[some])
        n1 = np.bincount(key % n, toxic[key // n], minlength=n).astype(np.int64)
        n0 = np.bincount(key % n, minlength=n) - n1
        return pa.RecordBatch.from_arrays(
            [pa.array(list(numbers), pa.string()), pa.array(n0[:len(numbers)]), pa.array(n1[:len(numbers)])], names=["term", "n0", "n1"])

    return sample.mapInArrow(count, "term string, n0 long, n1 long").groupBy("term") \
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def labelled(docs: DataFrame, labels: DataFrame, use) -> DataFrame:
    """The training sample (doc_id, toxic, text): about ``TRAIN_ROWS`` of the
    labelled documents for which ``use`` holds, chosen by hash; whole texts."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .filter("doc_id is not null and toxic is not null").filter(use).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, TRAIN_ROWS / max(1, marks.count()))
    chosen = marks.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    # of a repeated id one text (the least), so that the sample stays as small as its ids
    return written(chosen.join(texts, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "toxic", "text"),
                   "toxic-sample")


def fit(sample: DataFrame) -> tuple[Index, tuple[list[float], list[float]]]:
    """Index and calibration curve from rows (doc_id, toxic, text)."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, toxic = sum(n.values()), n.get(1, 0)
    if not rows:
        return Index([], [], 0, [], 0.0), ([0.0], [0.0])

    n0, n1, c0, c1 = F.col("n0"), F.col("n1"), float(rows - toxic), float(toxic)
    total = n0 + n1
    miss = rows - total

    def term(a, expected):
        return F.when(a > 0, a * F.log(a / expected)).otherwise(0.0)

    g2 = 2 * (term(n0, total * (c0 / rows)) + term(n1, total * (c1 / rows))
              + term(c0 - n0, miss * (c0 / rows)) + term(c1 - n1, miss * (c1 / rows)))
    best = _term_counts(sample).filter(total >= MIN_DOCS).select("term", total.alias("df"), g2.alias("g2")) \
        .filter(F.col("g2") >= MIN_G2).orderBy(F.desc("g2"), "term").limit(MAX_TERMS).collect()
    terms = [r["term"] for r in best]
    examples = _examples(sample, terms)
    index = Index(terms, [r["df"] for r in best], rows, examples, toxic / rows)
    raw = [index.vote(*index.nearest(t, w, skip=i)) for i, (t, w) in enumerate(index.vectors)]
    rest = rows - len(raw)
    rest_toxic = toxic - float(index.toxic.sum())
    x = np.array([*raw, index.prior])
    y = np.array([*index.toxic, rest_toxic / rest if rest else toxic / rows])
    w = np.array([1.0] * len(raw) + [float(max(rest, 1))])
    return index, isotonic(x, y, w)


def _scorer(index: Index, curve):
    """Function from an Arrow array of texts to scores and neighbours."""
    spark_state = (index.state, curve)

    def make(state):
        idx = Index(*state[0])
        table, (x, y), seen = idx.table(), state[1], {}

        def score(texts: pa.Array):
            none = float(np.interp(idx.prior, x, y))
            scores, near = np.full(len(texts), none), {}
            for d, (t, w) in idx.text_vectors(table, texts).items():
                key = (t.tobytes(), w.tobytes())
                if key not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    found, cosine = idx.nearest(t, w)
                    seen[key] = float(np.interp(idx.vote(found, cosine), x, y)), found, cosine
                scores[d], *near[d] = seen[key]
            return scores, near, idx
        return score
    return spark_state, make


def score_texts(docs: DataFrame, index: Index, curve) -> DataFrame:
    """Per document: doc_id, score, evidence (doc_id, cosine, toxic)."""
    state, make = _scorer(index, curve)
    shared, key = docs.sparkSession.sparkContext.broadcast(state), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("toxicity")
        if key not in store:
            store.clear()
            store[key] = make(shared.value)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for b in batches:
            scores, near, idx = store[key](b.column(1))
            evidence = [[{"doc_id": idx.ids[i], "cosine": float(c), "toxic": int(idx.toxic[i])} for i, c in zip(*near[d])]
                        if d in near else [] for d in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(evidence, kind)],
                                             names=["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")


def keep_clean(docs: DataFrame, index: Index, curve, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all their columns) that score below ``threshold``."""
    state, make = _scorer(index, curve)
    shared, key = docs.sparkSession.sparkContext.broadcast(state), uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("toxicity")
        if key not in store:
            store.clear()
            store[key] = make(shared.value)
        for b in batches:
            yield b.filter(pa.array(store[key](b.column(at))[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
