"""Suffix arrays and content-defined chunks."""

import hashlib
import random

import pytest
from brute import ODD, without_repeats

from tallyweave.llm import chunks
from tallyweave.llm import suffixes as op


def test_suffix_array():
    rng = random.Random(1)
    for size in range(60):
        for letters in ("a", "ab", "abcd", "aā\U0001f600"):
            s = "".join(rng.choice(letters) for _ in range(size))
            assert op.suffix_array(s) == sorted(range(size), key=lambda i: s[i:])


def passages(seed, docs=60):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(20, 90))) for _ in range(12)] + ["ab" * 40, "c" * 70]
    out = []
    for d in range(docs):
        parts = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            parts.append(p[a : a + rng.randrange(10, 90)] if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(50))))
        out.append((d, "".join(parts)))
    return out


def rows(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=repr)


@pytest.mark.parametrize("reach", [12, 21])
@pytest.mark.parametrize("limit", [1000, 2])
def test_repeats_against_brute_force(documents, reach, limit):
    docs = passages(reach)
    want = sorted(without_repeats(docs, 40), key=repr)
    assert sum(w[2] for w in want) > 500
    assert rows(op.without_repeats(documents(docs), 40, reach, limit)) == want


def test_odd_rows_and_whole_table(documents, small):
    docs = ODD + [(40, "start " + "y" * 401), (41, "y" * 400 + " end"), (9, ODD[8][1])]
    assert rows(op.without_repeats(documents(docs, clashing=True))) == sorted(without_repeats(docs, 400), key=repr)
    assert op.without_repeats(documents([])).count() == 0
    assert rows(op.without_repeats(documents(small))) == sorted(without_repeats(small, 400), key=repr)


def sequential_cuts(data, bits, least, most):
    ends, last, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(chunks._GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - last
        if (n >= least and h >> (32 - bits) == 0) or n > most:
            cut = i + 1 if n <= most else last + most
            while cut < len(data) and data[cut] & 0xC0 == 0x80:
                cut += 1
            if cut < len(data) and cut - last >= least:
                ends.append(cut)
                last = cut
    return ends + [len(data)] if data else []


def test_chunks_are_those_of_a_rolling_hash():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefé 漢") for _ in range(rng.randrange(3000))).encode() for _ in range(20)] + [b"", b"a", b"z" * 3000]
    for t, ends in zip(texts, chunks.cuts(texts, 5, 32, 512)):
        assert ends == sequential_cuts(t, 5, 32, 512)
        assert all(t[a:b].decode() for a, b in zip([0, *ends], ends))


def brute_chunks(docs, run=64):
    seen, out = set(), []
    for d, text in sorted(docs):
        t = text.encode()
        ends = sequential_cuts(t, 5, 32, 512)
        parts = [t[a:b] for a, b in zip([0, *ends], ends)]
        dup = []
        for p in parts:
            dup.append(p in seen)
            seen.add(p)
        kept, k = b"", 0
        while k < len(parts):
            j = k
            while j < len(parts) and dup[j]:
                j += 1
            if j > k and len(b"".join(parts[k:j])) >= run:
                k = j
            else:
                j = max(j, k + 1)
                kept += b"".join(parts[k:j])
                k = j
        out.append((d, kept.decode(), len(t), len(parts), len(t) - len(kept)))
    return out


def test_chunk_dedup(documents, small):
    found = chunks.deduplicated(documents(small)).collect()
    got = sorted((r["doc_id"], r["text"], r["n_bytes"], r["n_chunks"], r["n_removed"]) for r in found)
    assert got == brute_chunks(small) and sum(r[4] for r in got) > 0


def test_chunks_survive_shifts(documents, small):
    passage = next(t for _, t in small if len(t) > 3000)[:1500]
    rows = chunks.deduplicated(documents([(1, passage), (2, "something else in front, " + passage + " and behind")])).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["text"] == passage and by[2]["n_removed"] > 0.8 * len(passage.encode())


def test_odd_chunks(documents):
    found = {(r["doc_id"], r["text"]) for r in chunks.deduplicated(documents(ODD, clashing=True)).collect()}
    assert (1, None) in found and (2, "") in found and (5, "word") in found and (6, ODD[5][1]) in found
    assert chunks.deduplicated(documents([])).count() == 0
    assert [r["n_removed"] for r in chunks.deduplicated(documents([(7, "q" * 900)] * 2)).collect()] == [r["n_removed"] for r in chunks.deduplicated(documents([(7, "q" * 900)])).collect()] * 2
