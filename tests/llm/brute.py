"""Plain single-threaded versions of the operators, to hold their results against."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash


def simhash(text, words):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fingerprints, radius=3):
    """{fingerprint: smallest reachable one}"""
    fps = sorted(set(fingerprints))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def near_duplicates(docs, words, radius=3):
    """[(doc_id, fingerprint, component)] for (doc_id, text)"""
    fps = [simhash(t, words) for _, t in docs]
    of = groups(fps, radius)
    first = {}
    for (d, _), f in zip(docs, fps):
        if d is not None:
            first[of[f]] = min(first.get(of[f], d), d)
    return [(d, f, first.get(of[f])) for (d, _), f in zip(docs, fps)]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def contamination(docs, items, n):
    """[(doc_id, n_words, n_hit, items)]"""
    windows = {}
    for item, text in items:
        w = words_of(text)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def similar_lines(docs, threshold=0.8):
    """{(doc_id, line)} to go; doc ids are distinct"""
    seen, gone = [], set()
    for d, text in sorted((x for x in docs if x[1] is not None), key=lambda x: (x[0] is not None, x[0])):
        for k, line in enumerate(text.split("\n")):
            s = frozenset(w for w in re.split("[ \t\r]", line.lower()) if w)
            if not s:
                continue
            if any(len(s & o) >= threshold * len(s | o) - 1e-9 for o in seen):
                gone.add((d, k))
            seen.append(s)
    return gone


def without_lines(docs, threshold=0.8):
    gone = similar_lines(docs, threshold)
    return [(d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in docs]


def without_repeats(docs, length):
    """[(doc_id, bytes, removed, spans, sha256 of what is kept)]"""
    texts = [(t or "").encode() for _, t in docs]
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(docs, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def top_k(rows, is_query, k, scale=256):
    """[(query, rank, id, score)] for (id, vector)"""
    valid = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            valid[i] = [int(np.floor(scale * float(x))) for x in v]
    out = []
    for q in valid:
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(valid[q], v)), i) for i, v in valid.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


# nulls, empty, blank, repeated, long and non-ASCII texts, a missing id
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (6, "é ß 漢字 \U0001f600"), (7, "... !!! ---"), (8, "a\nb\n\na\nb"),
    (9, "the quick brown fox jumps over the lazy dog " * 3000), (10, "The Quick Brown Fox\njumps over"), (None, "no id"), (11, "x" * 5000), (12, "İstanbul J̌ á"),
]
