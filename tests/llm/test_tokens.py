"""Tokenisation, the id coder and best-fit packing."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import ODD
from tokenizers import Tokenizer

from tallyweave.llm import idcoder, packing
from tallyweave.llm.tokens import Encoder
from tallyweave.session import scratch_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " ", "a", "  two  blanks ", "tab\tand\nline\n\nend\n", "don't, we'll. 'S", "<|endoftext|> in <|startoftext|>text", "<|", "a\x01b \x01 c", "\0", "x\0 y",
    "á J̌ É İ ẞ", "no break em 　", "a\x1cb \x1d c\x85 d", "!!, wow._. x,. y. ", "漢字 かな \U0001f600‍!", "123,456. 7", "A" * 300, "﻿bom", "...", ", , .",
]


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_ids_are_those_of_the_whole_text(path, kind, small):
    encoder, whole = Encoder(path, kind), Tokenizer.from_file(path)
    texts = TEXTS + [t for _, t in small] + [" ".join(TEXTS), "".join(TEXTS), "\n".join(TEXTS[::-1])]
    for batch in ([t] for t in texts), [texts], [[None, *texts[:3], None]]:
        for some in batch:
            for t, ids in zip(some, encoder.encode(pa.array(some, pa.string()))):
                assert ids.tolist() == whole.encode(t or "", add_special_tokens=False).ids, t
    sliced = pa.array(["cut", *TEXTS], pa.string()).slice(1)
    assert [x.tolist() for x in encoder.encode(sliced)] == [whole.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert encoder.encode(pa.array([], pa.string())) == []


def test_memo_is_bounded(monkeypatch, small):
    monkeypatch.setattr("tallyweave.llm.tokens.MEMO", 50)
    encoder, whole = Encoder(WORD, "word"), Tokenizer.from_file(WORD)
    for t, ids in zip([t for _, t in small], encoder.encode(pa.array([t for _, t in small]))):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids
    assert len(encoder.memo) <= 50


@pytest.mark.parametrize("sizes", [[], [1], [8192, 8191, 1], [300] * 40])
def test_blocks_round_trip(sizes):
    rng = np.random.default_rng(4)
    for blocks in (
        [rng.integers(0, 1 << 16, n) for n in sizes],
        [np.full(n, 65535) for n in sizes],
        [np.arange(n) % 7 for n in sizes],
        [rng.zipf(1.3, n) % 50000 for n in sizes],
    ):
        words = idcoder.encode_blocks(blocks)
        assert all((a == b).all() for a, b in zip(blocks, idcoder.decode_blocks(words, sizes)))


def test_contexts_pay():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 50000, 50)
    (words,) = idcoder.encode_blocks([np.tile(phrase, 100)])
    assert 2 * len(words) < 0.12 * 2 * 5000


def test_segments_detect_damage():
    docs = [np.array([1, 2, 50000]), np.zeros(0, int), np.arange(20000) % 900]
    segment = idcoder.write_segment([5, None, -3], docs)
    (back,) = idcoder.read_segments([segment])
    assert [d for d, _ in back] == [5, None, -3] and all((a == b).all() for a, (_, b) in zip(docs, back))
    for at in (0, 10, 30, len(segment) - 9):
        broken = bytearray(segment)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            idcoder.read_segments([bytes(broken)])


def test_files(spark, documents, small):
    docs = small + [(1000 + (d or 0), t) for d, t in ODD if d] + [(None, "none")] + [small[3]]
    path = scratch_path(spark, "test-ids")
    idcoder.write(documents(docs, clashing=True), path, BYTE, end_id=2)
    got = idcoder.read(spark, path).collect()
    whole, at, want = Tokenizer.from_file(BYTE), 0, []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == [(d, s, n, bytearray(b)) for d, s, n, b in want]
    empty = scratch_path(spark, "test-ids")
    idcoder.write(documents([]), empty, BYTE, end_id=2)
    assert idcoder.read(spark, empty).count() == 0


def test_best_fit_takes_the_tightest_open_bin():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 3, 1)] == [(0, 0), (0, 6), (0, 9)]
    assert [fit.place(n) for n in (7, 8, 2, 5)] == [(1, 0), (2, 0), (2, 8), (3, 0)]
    # 1 (3 free) and 3 (5 free) are open; one more closes the fuller one
    assert fit.place(9) == (4, 0) and fit.place(3) == (3, 5) and fit.count <= 2


def check_packing(rows, docs, capacity):
    whole, want = Tokenizer.from_file(WORD), []
    for d, t in docs:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d, k, a, zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], zlib.crc32(r["ids"])) for r in rows), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(documents, small, capacity):
    docs = small + [(d if d is None else d + 500, t) for d, t in ODD] + [small[0]]
    rows = packing.packed(documents(docs, clashing=True), WORD, 1, capacity=capacity).collect()
    used, least = check_packing(rows, docs, capacity)
    assert used <= 1.01 * least + 1
    assert packing.packed(documents([]), WORD, 1).count() == 0


def test_packing_with_few_open_bins(documents, small):
    rows = packing.packed(documents(small), WORD, 1, capacity=512, open_bins=3).collect()
    check_packing(rows, small, 512)
