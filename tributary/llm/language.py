"""Language identification of mixed texts.

*Narrow*: a word's script (by code point ranges) leaves only the languages
that use the script.  *Score*: each word gets a score per candidate language,
the log-probability of its character n-grams.  *Label*: Viterbi over the
words, with a penalty for each change of language, cuts the text into spans
of one language.  The language with most letters in its spans is predicted;
the score is the lesser of its share of letters and its posterior.

A text whose best other language never gains more than one penalty over any
run of words has one span, whatever path is tried; such texts (nearly all)
are found with cumulative sums, and only the others are decoded word by word.

The model is fitted on at most about ``TRAIN_DOCS`` whole documents per
language, chosen by hash; it has at most ``MAX_GRAMS`` n-grams.

Rows: null texts and texts without a letter are ``und`` with score 0, and so
is every text if no language was learned; a text whose letters belong to no
learned script gets the most frequent language with score 0; repeated rows
get equal results; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_store, written
from .words import WordTable, coded_words, doc_of

TRAIN_DOCS = 1500
MAX_GRAMS = 60_000
GRAM_SIZES = (1, 2, 3, 4)
TABLE_SLOTS = 1 << 20
SWITCH_PENALTY = 10.0
WORD_LIMIT = 4.0        # most that one word may speak for a language against the mean
MIN_SCRIPT_SHARE = 0.02

# First code points of blocks and the script of their letters.
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
           (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
           (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
           (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
           (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
           (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
           (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
           (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"),
           (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
           (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "other"),
           (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x30000, "other"))
SCRIPT_NAMES = tuple(dict.fromkeys(s for _, s in SCRIPTS))
_STARTS = [a for a, _ in SCRIPTS]


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def core(word: str) -> str:
    """The word in lower case without what is no letter or mark at its ends."""
    word = word.lower()
    if word.isalpha():
        return word
    letters = [i for i, c in enumerate(word) if c.isalpha() or unicodedata.category(c)[0] == "M"]
    return word[letters[0]:letters[-1] + 1] if letters else ""


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character n-grams of all words, both ends marked: hash, position of the
    first character in the joined words, and the word's number per position."""
    cp = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    mark = np.zeros(len(cp), bool)
    mark[first] = mark[first + size - 1] = True
    hashes, at, h = [], [], np.zeros(len(cp), np.uint64)
    for n in range(1, max(GRAM_SIZES) + 1):
        k = len(cp) - n + 1
        if k <= 0:
            break
        h = h[:k] * np.uint64(0x100000001B3) + cp[n - 1:] + np.uint64(n)
        inside = word[:k] == word[n - 1:]
        if n == 1:
            inside = ~mark
        if n in GRAM_SIZES:
            x = h[inside]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes.append(((x ^ (x >> np.uint64(32))) & ~np.uint64(7)) | np.uint64(n))
            at.append(np.flatnonzero(inside))
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), word
    return np.concatenate(hashes).view(np.int64), np.concatenate(at), word


def _script(word: str) -> int:
    if word.isascii():
        return SCRIPT_NAMES.index("latin")
    for c in word:
        if c.isalpha():
            return SCRIPT_NAMES.index(script_of(c))
    return -1


class Model:
    """Log-probabilities of n-grams per language and candidates per script."""

    def __init__(self, languages: list[str], keys: np.ndarray, counts: np.ndarray, scripts: dict[str, list[float]], docs: list[int]):
        """``keys``: hashes of n-grams, most frequent first; ``counts``: one row each."""
        self.state = (languages, keys, counts, scripts, docs)     # plain values: what is broadcast
        self.languages = languages
        keys, n = np.asarray(keys, np.int64), np.asarray(counts, float).reshape(len(keys), len(languages))
        size = keys & 7
        logs = np.zeros_like(n)
        for s in set(size.tolist()):
            rows = size == s
            logs[rows] = np.log((n[rows] + 0.2) / (n[rows].sum(axis=0) + 0.2 * rows.sum()))
        logs = logs - logs.mean(axis=1, keepdims=True) if len(languages) else logs
        # Open table of hashes; of two n-grams in one slot the more frequent is used.
        self.slots = np.zeros(TABLE_SLOTS, np.int32)
        where = (keys.view(np.uint64) >> np.uint64(40)).astype(np.int64) % TABLE_SLOTS
        self.slots[where[::-1]] = np.arange(len(keys), 0, -1)
        self.keys = np.concatenate([[0], keys])
        self.logs = np.concatenate([np.zeros((1, len(languages))), logs]).astype(np.float32)
        use = np.array([scripts.get(s, [0.0] * len(languages)) for s in SCRIPT_NAMES], float)
        self.candidates = use >= MIN_SCRIPT_SHARE
        self.common = int(np.argmax(docs)) if docs else 0

    def scores(self, words: list[str]) -> np.ndarray:
        """Per word: one score per language, then its number of letters, then
        whether any language uses its script."""
        cores = list(map(core, words))
        number: dict[str, int] = {}
        which = np.fromiter((number.setdefault(c, len(number)) for c in cores), np.int64, len(cores))
        return self._scores(list(number))[which]

    def _scores(self, cores: list[str]) -> np.ndarray:
        n_lang = len(self.languages)
        out = np.zeros((len(cores), n_lang + 2), np.float32)
        scripts = np.array([_script(c) if c else -1 for c in cores])
        out[:, n_lang] = [len(c) if c.isalpha() else sum(map(str.isalpha, c)) for c in cores]
        hashes, at, word = grams(cores)
        row = self.slots[(hashes.view(np.uint64) >> np.uint64(40)).astype(np.int64) % TABLE_SLOTS]
        known = (self.keys[row] == hashes) & (row > 0)
        owner, row = word[at[known]], row[known]
        if len(row) and n_lang:
            hits = np.maximum(1, np.bincount(owner, minlength=len(cores)))[:, None] ** 0.5
            sums = np.stack([np.bincount(owner, self.logs[row, j], len(cores)) for j in range(n_lang)], axis=1)
            out[:, :n_lang] = np.clip(sums / hits, -WORD_LIMIT, WORD_LIMIT)
        lettered = (scripts >= 0) & (out[:, n_lang] > 0)
        allowed = np.zeros((len(cores), n_lang), bool)
        allowed[lettered] = self.candidates[scripts[lettered]]
        some = allowed.any(axis=1) if n_lang else np.zeros(len(cores), bool)
        out[:, :n_lang] = np.where(some[:, None], np.where(allowed, out[:, :n_lang], -2 * WORD_LIMIT), 0)
        out[:, n_lang + 1] = some
        return out


def decode(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Most likely language of each word, a change costing ``penalty``."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int16)
    best = scores[0].tolist()
    for i in range(1, n):
        m = max(best)
        j, m = best.index(m), m - penalty
        row, e = back[i], scores[i].tolist()
        for s in range(k):
            if best[s] >= m:
                row[s] = s
                best[s] += e[s]
            else:
                row[s] = j
                best[s] = m + e[s]
    path = np.empty(n, np.int64)
    path[-1] = int(np.argmax(best))
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def one_span(scores: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH_PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Best single language per text, and whether it is the best path.

    It is if no run of words inside the text gains more than two penalties by
    other languages, and none at the text's start or end more than one."""
    n_docs, doc, k = len(bounds) - 1, doc_of(bounds), scores.shape[1]
    best, single = np.zeros(n_docs, np.int64), np.ones(n_docs, bool)
    if not len(doc) or k < 2:
        return best, single
    some = np.flatnonzero(np.diff(bounds))
    first = bounds[some]
    best[some] = np.add.reduceat(scores, first, axis=0, dtype=np.float64).argmax(axis=1)
    own = best[doc]
    others = scores.copy()
    others[np.arange(len(doc)), own] = -np.inf
    step = (others.max(axis=1) - scores[np.arange(len(doc)), own]).astype(np.float64)
    run = np.cumsum(step)
    base = run[first] - step[first]
    # prefix sums from each text's start
    pre = run - np.repeat(base, np.diff(bounds)[some])
    high, low, total = np.maximum.reduceat(pre, first), np.minimum.reduceat(pre, first), pre[bounds[some + 1] - 1]
    edge = np.maximum(high, total - np.minimum(low, 0.0))
    # largest run: prefix sum against the least prefix sum before it; texts are set far apart
    far = 2.0 * np.abs(step).sum() + 1.0
    if far * n_docs > 1e12:     # too far for the sums' digits: texts where any step gains are left to the decoder
        inner = np.where(np.maximum.reduceat(step, first) > 0, np.inf, 0.0)
    else:
        shift = far * doc
        before = np.minimum.accumulate(np.where(np.isin(np.arange(len(doc)), first), 0.0, pre - step) - shift)
        inner = np.maximum.reduceat(pre - shift - before, first)
    single[some] = (edge <= penalty) & (inner <= 2 * penalty)
    return best, single


def label_texts(model: Model, table: WordTable, texts: pa.Array):
    """Per text: predicted language, score, spans (language, first word, words)."""
    names, codes, bounds = coded_words(texts)
    n_lang = len(model.languages)
    rows = table.lookup(names.to_pylist())[codes] if len(names) else np.zeros((0, n_lang + 2), np.float32)
    scores, letters, some = rows[:, :n_lang], rows[:, n_lang], rows[:, n_lang + 1]
    doc = doc_of(bounds)
    all_letters = np.bincount(doc, letters, len(bounds) - 1)
    best, single = one_span(scores, bounds)
    out = []
    for d in range(len(bounds) - 1):
        a, b = int(bounds[d]), int(bounds[d + 1])
        if not all_letters[d] or not n_lang:
            out.append(("und", 0.0, []))
            continue
        if not some[a:b].any():
            out.append((model.languages[model.common], 0.0, [(model.languages[model.common], 0, b - a)]))
            continue
        if single[d]:
            pred, share, spans = int(best[d]), 1.0, [(model.languages[best[d]], 0, b - a)]
        else:
            path = decode(scores[a:b])
            weight = np.bincount(path, letters[a:b], n_lang)
            pred, share = int(weight.argmax()), float(weight.max() / weight.sum())
            cuts = np.flatnonzero(np.diff(path)) + 1
            edges = [0, *cuts.tolist(), b - a]
            spans = [(model.languages[path[x]], x, y - x) for x, y in zip(edges[:-1], edges[1:])]
        total = scores[a:b].sum(axis=0, dtype=np.float64)
        posterior = 1.0 / np.exp(np.minimum(total - total[pred], 50.0)).sum()
        out.append((model.languages[pred], float(min(share, posterior)) if single[d] else share, spans))
    return out


def fit(train: DataFrame) -> Model:
    """Fit on rows (text, lang, order): counts of n-grams and of scripts."""
    per = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(per)
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0)), {}, [])
    rate = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, TRAIN_DOCS / per[k]))])
    part = F.pmod(F.xxhash64(F.lit("language"), "order"), F.lit(1 << 20)) / float(1 << 20)
    sample = train.filter(part < F.element_at(rate, F.col("lang"))).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # n-grams carry their size in the last three bits; scripts are 0 to -29
        for b in batches:
            names, codes, bounds = coded_words(b.column(0))
            words = [core(w) for w in names.to_pylist()]
            scripts = -np.array([_script(w) if w else -1 for w in words], np.int64)
            hashes, at, word = grams(words)
            owner = word[at]
            langs = np.array(b.column(1).to_pylist(), object)
            own = langs[doc_of(bounds)]
            for lang in sorted(set(langs.tolist())):
                n = np.bincount(codes[own == lang], minlength=len(words)).astype(float)
                # frequent words count by the root, so that they do not drown the rest
                root = np.sqrt(n)[owner]
                key, inverse = np.unique(hashes[root > 0], return_inverse=True)
                times = np.bincount(inverse, root[root > 0], len(key))
                used = scripts <= 0
                key2, inverse2 = np.unique(scripts[used], return_inverse=True)
                key, times = np.concatenate([key, key2]), np.concatenate([times, np.bincount(inverse2, n[used], len(key2))])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key, pa.int64()), pa.array(times)],
                                                 names=["lang", "gram", "n"])

    is_gram = (F.col("gram") > 0) | (F.col("gram") < -64)
    counts = sample.mapInArrow(count, "lang string, gram long, n double").groupBy("gram").agg(
        *[F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0.0)).alias(f"n{i}") for i, k in enumerate(languages)],
        F.sum("n").alias("all"))
    counts = written(counts, "grams")
    width = range(len(languages))
    top = counts.filter(is_gram).orderBy(F.desc(F.round("all", 6)), "gram").limit(MAX_GRAMS).toPandas()
    use = counts.filter(~is_gram).collect()
    seen = np.array([[r[f"n{i}"] for i in width] for r in use]).sum(axis=0) if use else np.ones(len(languages))
    scripts = {SCRIPT_NAMES[-r["gram"]]: [r[f"n{i}"] / max(seen[i], 1.0) for i in width] for r in use}
    return Model(languages, top["gram"].to_numpy(np.int64), top[[f"n{i}" for i in width]].to_numpy(float), scripts, [per[k] for k in languages])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, lang_pred, score, spans."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.state)
    key = uuid.uuid4().hex

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("language")
        if key not in store:
            store.clear()
            m = Model(*shared.value)
            store[key] = m, WordTable(m.scores, len(m.languages) + 2, np.float32)
        m, table = store[key]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))
        for b in batches:
            found = label_texts(m, table, b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                 pa.array([[{"lang": s[0], "first_word": s[1], "n_words": s[2]} for s in x[2]] for x in found], kind)],
                names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(label, "doc_id long, lang_pred string, score double, "
                           "spans array<struct<lang: string, first_word: int, n_words: int>>")
