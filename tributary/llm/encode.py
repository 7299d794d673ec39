"""Whole-text encoding with a public tokenizer, one encode per distinct chunk.

The tokenizer's pre-tokenizer never lets a token span ASCII white space, so
the ids of a text are the ids of its white-space chunks, one after the other.
A batch of texts is split and dictionary-encoded in Arrow; only chunks that
this Python worker has not met yet reach the tokenizers library, many of them
as one text, and the ids of the batch are gathered with numpy.  When the cache reaches ``CACHE_CHUNKS``
chunks it keeps those that came up most often.
"""

from __future__ import annotations

import itertools
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_store
from .csr import spread
from .words import plain

CACHE_CHUNKS = 1_000_000
JOINED = 2000     # chunks that are encoded in one call
_PUNCT = string.punctuation


class ChunkEncoder:
    """Encodes Arrow string arrays into one flat id array and per-text lengths."""

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # The vocabulary of a lower-casing tokenizer does not see ASCII case.
        probe = self.tokenizer.encode_batch_fast(["aZ Q", "az q"], add_special_tokens=False)
        self.caseless = probe[0].ids == probe[1].ids
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.names = pa.array([], pa.large_string())        # chunks in order of their numbers
        self.lengths, self.hits = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)                  # their ids, one after the other

    def trim(self) -> None:
        """Keep the chunks that came up in most batches, half a cache at most."""
        n = len(self.names)
        least = max(2, int(np.sort(self.hits)[-min(n, CACHE_CHUNKS // 2)]) + 1) if n else 2
        keep = np.flatnonzero(self.hits >= least)
        self.flat = self.flat[spread(self.starts[keep], self.lengths[keep])]
        self.names, self.lengths = self.names.take(pa.array(keep)), self.lengths[keep]
        self.hits = np.zeros(len(keep), np.int32)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _each(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks and the number of each.  Many chunks are one
        text, with a special token between two (no chunk holds one)."""
        if not self.specials:
            return self.encode_distinct(chunks.to_pylist())
        mark = self.specials[0]
        ids, lens, own = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], self.tokenizer.token_to_id(mark)
        for i in range(0, len(chunks), JOINED):
            names = chunks.slice(i, JOINED).to_pylist()
            found = np.array(self._encode([mark.join(names)])[0], np.uint32)
            at = np.flatnonzero(found == own)
            if len(at) != len(names) - 1:
                raise ValueError("a chunk holds a special token")
            ids.append(np.delete(found, at))
            lens.append(np.diff(np.concatenate([[-1], at, [len(found)]])) - 1)
        return np.concatenate(ids), np.concatenate(lens)

    def _find(self, chunks: pa.Array) -> np.ndarray:
        """Number of each of these distinct chunks, -1 if new.  The hash table
        is of these chunks; one of all the cache's would be made anew a batch."""
        at = pc.index_in(self.names, value_set=chunks)
        known = np.flatnonzero(np.asarray(at.is_valid()))
        out = np.full(len(chunks), -1, np.int64)
        out[np.asarray(at.drop_null())] = known
        return out

    def _add(self, chunks: pa.Array) -> np.ndarray:
        """Encode new chunks and return their numbers.  A trailing ASCII punctuation run after a letter
        or digit is a token sequence of its own, so it is encoded apart."""
        core = pc.utf8_rtrim(chunks, characters=_PUNCT)
        size = np.asarray(pc.binary_length(core)).astype(np.int64)
        cut = np.asarray(pc.and_(pc.match_substring_regex(core, r"[\p{L}0-9]$"), pc.not_equal(core, chunks)))
        head = pc.if_else(pa.array(cut), core, chunks)
        data = chunks.filter(pa.array(cut)).to_pylist()
        tail = pa.array([c.encode()[n:].decode() for c, n in zip(data, size[cut].tolist())], pa.large_string())
        parts = pa.concat_arrays([head, tail]).dictionary_encode()
        at = self._find(parts.dictionary)
        new = np.flatnonzero(at < 0)
        at[new] = len(self.names) + np.arange(len(new))
        fresh = parts.dictionary.take(pa.array(new))
        self._append(fresh, *self._each(fresh))
        at = at[np.asarray(parts.indices)]
        # chunks with a tail: the ids of their parts, one after the other
        both = np.stack([at[:len(chunks)][cut], at[len(chunks):]], 1).reshape(-1)
        lens = self.lengths[both].astype(np.int64)
        own = at[:len(chunks)]
        own[cut] = len(self.names) + np.arange(len(size[cut]))
        self._append(chunks.filter(pa.array(cut)), self.flat[spread(self.starts[both], lens)], lens.reshape(-1, 2).sum(1))
        return own

    def _append(self, chunks: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, chunks])
        self.lengths = np.concatenate([self.lengths, lens.astype(np.int32)])
        self.hits = np.concatenate([self.hits, np.zeros(len(chunks), np.int32)])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def encode_distinct(self, chunks: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, without the cache, and the number of each."""
        ids, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(chunks), step):
            found = self._encode(chunks[i:i + step])
            lens.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lens[-1].sum())))
        return np.concatenate(ids), np.concatenate(lens)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each followed by ``end`` if given,
        and the number of ids of each text."""
        texts = plain(texts)
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        direct = self._direct(texts)
        if direct.any():
            texts = pc.if_else(pa.array(direct), pa.scalar("", pa.large_string()), texts)
        chunks = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.caseless else texts)
        bounds = np.asarray(chunks.offsets).astype(np.int64)
        coded = chunks.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        names = coded.dictionary
        if len(self.names) + len(names) > CACHE_CHUNKS:
            self.trim()
        slots = self._find(names)
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            slots[fresh] = self._add(names.take(pa.array(fresh)))
        slots = slots.astype(np.int32)
        self.hits[slots] += 1
        at = slots[np.asarray(coded.indices)]
        del chunks, coded, names
        per_chunk = self.lengths[at]
        sums = np.concatenate([[0], np.cumsum(per_chunk, dtype=np.int64)])
        per_text = sums[bounds[1:]] - sums[bounds[:-1]]
        total = int(sums[-1])
        kind = np.int32 if total + len(self.flat) < 1 << 31 else np.int64
        where = np.repeat((self.starts[at] - sums[:-1]).astype(kind), per_chunk)
        where += np.arange(total, dtype=kind)
        ids = self.flat[where]
        del where
        if direct.any():
            ids, per_text = self._splice(ids, per_text, direct)
        if end is not None:
            ids = np.insert(ids, np.cumsum(per_text), end)
            per_text = per_text + 1
        return ids, per_text

    def _direct(self, texts: pa.Array) -> np.ndarray:
        """Texts that hold a special token's string, in any letter case, are
        encoded whole by the library."""
        hit = np.zeros(len(texts), bool)
        for s in self.specials:
            hit |= np.asarray(pc.match_substring(texts, s, ignore_case=True))
        self._texts = [texts[int(i)].as_py() for i in np.flatnonzero(hit)]
        return hit

    def _splice(self, ids, per_text, direct):
        own = self._encode(self._texts)
        ends = np.cumsum(per_text)
        out, last = [], 0
        for i, x in zip(np.flatnonzero(direct), own):
            out += [ids[last:ends[i]], np.array(x, np.uint32)]
            last = ends[i]
            per_text[i] = len(x)
        return np.concatenate([*out, ids[last:]]).astype(np.uint32), per_text


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file, with its cache."""
    store = worker_store("encoders")
    if path not in store:
        store[path] = ChunkEncoder(path)
    return store[path]


def vocabulary_size(path: str) -> int:
    return ChunkEncoder(path).vocabulary
