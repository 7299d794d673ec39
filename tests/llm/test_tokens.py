"""Bit-packed ids (1) and best-fit packing (3) against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import EDGE, order, real_rows, wide
from tokenizers import Tokenizer

from tributary.llm import best_fit, id_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = EDGE + real_rows()


@pytest.fixture(scope="module")
def expected():
    tok = Tokenizer.from_file(PATH)
    return [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"), t) for i, t, _, _ in ROWS]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 32])
@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 4096, 5000])
def test_pack_round_trip(bits, n):
    ids = np.random.default_rng(n + bits).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    packed = id_files.pack(ids, bits)
    assert len(packed) == -(-n // 32) * bits * 4
    assert (id_files.unpack(packed, n, bits) == ids).all()


def test_segment_random_access():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 3, 9000, 1, 5000])
    ids = rng.integers(0, 49408, lengths.sum()).astype(np.uint32)
    s = id_files.Segment(id_files.make_segment([5, None, 7, 8, 9], lengths, ids, 16))
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    for k in range(5):
        assert (s.document(k) == ids[cuts[k]:cuts[k + 1]]).all()
    assert (s.read(4090, 4100) == ids[4090:4100]).all() and s.null.tolist() == [False, True, False, False, False]


def test_bits():
    assert [id_files.bits_for(v) for v in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_ids_written_and_read(spark, expected):
    got = id_files.read_index(id_files.write_ids(wide(spark, ROWS), PATH, 1)).collect()
    want, start = [], 0
    for i, ids, _ in sorted(expected, key=lambda r: (order(r[0]), order(r[2]) if r[2] is None else (True, r[2].encode()))):
        want.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty_table(spark):
    none = wide(spark, EDGE).limit(0)
    assert id_files.read_index(id_files.write_ids(none, PATH, 1)).count() == 0
    assert best_fit.best_fit(none, PATH, 1).count() == 0


def test_packing(spark, expected):
    got = best_fit.best_fit(wide(spark, ROWS), PATH, 1).collect()
    want = defaultdict(list)
    for i, ids, _ in expected:
        for p in range(0, len(ids), 4096):
            part = ids[p:p + 4096]
            want[i].append((p // 4096, p, len(part), zlib.crc32(part)))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(len(ids) for _, ids, _ in expected)
    assert len(places) <= -(-total // 4096) + 1


def test_best_fit_takes_the_tightest():
    rng = np.random.default_rng(0)
    lengths = sorted(rng.integers(1, 60, 300).tolist(), reverse=True)
    at, offsets, n = best_fit.best_fit_decreasing(lengths, 64)
    room = []       # brute force
    for length, k, o in zip(lengths, at, offsets):
        fits = [r for r in room if r >= length]
        if fits:
            assert room[k] == min(fits) and o == 64 - room[k]
        else:
            assert k == len(room) and o == 0
            room.append(64)
        room[k] -= length
    assert len(room) == n


def test_lookups_hash_the_batch_not_the_cache(monkeypatch):
    import pyarrow as pa

    from tributary.llm import encode
    tok = encode.ChunkEncoder(PATH)
    tok.encode(pa.array([" ".join(f"word{k}" for k in range(3000))]))
    sizes, index_in = [], encode.pc.index_in
    monkeypatch.setattr(encode.pc, "index_in", lambda x, value_set: sizes.append(len(value_set)) or index_in(x, value_set=value_set))
    texts = ["word7 new, word2999 new. (word8)", "newer, newer new,"]
    ids, lens = tok.encode(pa.array(texts))
    assert max(sizes) < 20
    want = [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and lens.tolist() == [len(x) for x in want]
