"""SimHash by covering masks, and components."""

import collections
import itertools
import random

import numpy as np
import pytest
from brute import ODD, groups, near_duplicates, simhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallyweave.llm import shingles
from tallyweave.llm import simhash as op
from tallyweave.llm.common import CLEANUP, stored
from tallyweave.llm.components import components


def rows(df):
    return sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b", "A b C d E f", "x " * 500, "é è É ù   z"])
@pytest.mark.parametrize("words", [3, 5])
def test_fingerprint(text, words):
    assert op.fingerprint(None if text is None else text.encode(), words) % (1 << 64) == simhash(text, words)


@pytest.mark.parametrize("turn", [0, 1])
def test_masks_cover_every_pair_within_the_radius(turn):
    masks = [m % (1 << 64) for m in op.covering_masks(3, turn)]
    assert len(masks) == 15
    assert all(any(not (m >> i & 1 or m >> j & 1 or m >> k & 1) for m in masks) for i, j, k in itertools.combinations(range(64), 3))


def test_whole_table(documents, small):
    assert rows(op.near_duplicates(documents(small))) == sorted(near_duplicates(small, 3), key=repr)


def test_odd_rows(documents):
    assert rows(op.near_duplicates(documents(ODD, clashing=True))) == sorted(near_duplicates(ODD, 3), key=repr)
    assert op.near_duplicates(documents([])).count() == 0
    kept = op.keep_first(documents(ODD + [ODD[0], ODD[8]], clashing=True))
    ids = [r["doc_id"] for r in kept.collect()]
    firsts = {c for _, _, c in near_duplicates(ODD, 5)}
    assert sorted(map(str, ids)) == sorted(map(str, firsts)) and "n_hit" in kept.columns


def test_one_row_stays_of_each_component_whatever_its_id(documents):
    texts = [f"text {w} about {w} and nothing but {w}" for w in ("apples", "boats", "clouds")]
    rows = [(None, t) for t in texts] + [(None, texts[0]), (7, "quite another story"), (7, "and a third one, told at length"), (9, "quite another story"), (7, texts[2])]
    kept = sorted(((r["doc_id"], r["text"]) for r in op.keep_first(documents(rows)).collect()), key=repr)
    assert kept == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, "quite another story"), (7, "and a third one, told at length")], key=repr)


def jaccard_components(docs, words=5, similarity=0.8, radius=3):
    """{doc_id: smallest doc_id reachable} by brute force over all pairs; ids are distinct"""
    w = [(t or "").lower().split() for _, t in docs]
    sets = [frozenset(tuple(x[i : i + words]) for i in range(max(1, len(x) - words + 1))) if x else frozenset() for x in w]
    fps = [simhash(t, words) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    wide = 0
    for i, j in itertools.combinations(range(len(docs)), 2):
        s, t, far = sets[i], sets[j], (fps[i] ^ fps[j]).bit_count()
        both = len(s & t)
        if s == t or both >= similarity * (len(s) + len(t) - both) - 1e-9 or far <= radius:
            wide += far > radius
            x, y = sorted((find(i), find(j)), key=lambda k: docs[k][0])
            root[y] = x
    return {d: docs[find(i)][0] for i, (d, _) in enumerate(docs)}, wide


def test_every_pair_of_the_similarity_is_linked(spark, documents, small):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(30)]
    docs = list(small)
    for group in range(12):
        base = [word() for _ in range(rng.choice((6, 12, 40, 150, 600)))] + passage * (group % 2)
        for copy in range(25 if group < 2 else 6):
            text = list(base)
            for _ in range(max(1, rng.randrange(1 + len(base) // 60))):
                text[rng.randrange(len(text))] = word()
            docs.append((10_000 + 100 * group + copy, " ".join(text)))
    docs += [(20_000, "a b c d e f g a b c d e f g"), (20_001, "A b c d e f g a b c d e f g a b c"), (20_002, "x y"), (20_003, "X  y")]
    want, wide = jaccard_components(docs)
    assert wide > 50  # links that three bits miss
    found = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(documents(docs), 5, similarity=0.8).collect()}
    assert found == want
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(docs), "").collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_frequencies_come_from_every_document(spark, documents):
    phrase = "one phrase that all of these share"
    texts = [f"{phrase} w{i} x{i} y{i} z{i}" for i in range(40)] + [None, "", "short"]
    rows = documents(list(enumerate(texts))).select("text").withColumn("text", F.col("text").cast("binary"))
    want = collections.Counter()
    for t in texts:
        for h in {int(x) for x in op.shingle_hashes((t or "").encode(), 5)}:
            want[int(shingles._class_of(np.array([h], np.uint64))[0])] += 1
    ranks = shingles._ranks(rows.repartition(3), 5)
    assert {int(c): int(ranks[c]) for c in np.flatnonzero(ranks)} == {c: n.bit_length() for c, n in want.items()}
    assert max(want.values()) >= 40 and not shingles._ranks(rows.limit(0), 5).any()


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = spark.conf.get(CLEANUP, "false")
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert stored(df, "test-shuffles").count() == 7 and spark.conf.get(CLEANUP, "false") == before
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = sum(b.isShuffle() for b in [x for x in [shuffles.getAllBlocks().apply(i) for i in range(shuffles.getAllBlocks().size())]])
    stored(df, "test-shuffles")
    assert sum(b.isShuffle() for b in [shuffles.getAllBlocks().apply(i) for i in range(shuffles.getAllBlocks().size())]) <= left


@pytest.mark.parametrize("limit", [512, 2])
def test_links_of_dense_groups(spark, limit):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(6):  # chains and balls around a centre
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}))
        for _ in range(20):
            centre ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(centre)
    signed = {int(np.uint64(f).astype(np.int64)): f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    found = {r["node"]: r["root"] for r in components(op.links(df, 3, limit)).collect()}
    got = {}
    for s, f in signed.items():
        got.setdefault(found.get(s, s), set()).add(f)
    want = {}
    for f, g in groups(fps).items():
        want.setdefault(g, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, x) for x in range(1001, 1100)] + [(5, 5), (7, 6), (3000, 2999)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(201)) and all(found[x] == 1000 for x in range(1000, 1100)) and found[3000] == 2999
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_parities_of_sets_of_other_sizes():
    rng = np.random.default_rng(3)
    tokens = np.unique(rng.integers(0, 2**63, 9000).astype(np.uint64))
    for a, b in ((900, 1100), (4000, 4400), (8000, 8900)):
        x, y = tokens[:a], tokens[100:b]
        assert 0 < shingles._apart(shingles._parity(x), shingles._parity(y)) <= 100 + b - a
    assert shingles._apart(shingles._parity(tokens[:0]), shingles._parity(tokens[:1])) == 1
    # large sets that share nothing are told apart; with 1,024 classes they could not be
    x, y = (shingles._parity(t) for t in (tokens[:4000], tokens[4000:8000]))
    assert shingles._apart(x, y) > 8000 - 2 * np.ceil(8000 * 0.8 / 1.8)
