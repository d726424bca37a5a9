"""Hard negatives against plain loops, Strassen's products against numpy's."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import knn, negatives

SCHEMA = "id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (7, 64, 9), (65, 33, 70), (128, 64, 100), (0, 4, 3), (5, 0, 6)])
@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_products(shape, leaf):
    rng = np.random.default_rng(5)
    n, m, k = shape
    a, b = rng.integers(-300, 300, (n, m)), rng.integers(-300, 300, (m, k))
    assert (negatives.strassen(a, b, leaf) == a @ b).all()


def test_products_of_large_numbers_are_exact():
    rng = np.random.default_rng(6)
    a, b = rng.integers(-(1 << 29), 1 << 29, (40, 9)), rng.integers(-(1 << 29), 1 << 29, (9, 50))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b.T] for r in a])
    assert (negatives.strassen(a, b, 2) == want).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(7)
    slot, score, ids = rng.integers(0, 5, 300), rng.integers(0, 20, 300), np.arange(300)
    results = set()
    for order in (np.arange(300), rng.permutation(300)):
        heaps = negatives.Heaps(6, 3)
        for some in np.array_split(order, 7):
            heaps.add(slot[some], score[some], ids[some])
        results.add(tuple(zip(*(x.tolist() for x in heaps.entries()))))
    best = [(s, -v, i) for s in range(5) for v, i in sorted((-score[j], ids[j]) for j in np.flatnonzero(slot == s))[:3]]
    assert results == {tuple(best)}


def brute(rows, every, positives=5, count=3):
    clean = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.add((i, tuple(math.floor(256 * x) for x in v), label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, label in clean:
        if i % every:
            continue
        scored = [(-dot(v, w), j, m) for j, w, m in clean if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            window = sorted((t, k) for t, k, m in scored if m != label and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(window[:count])]
    return sorted(out)


def found(spark, rows, every=5, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' as `{c}`" for c in ("block", "score", "rank", "a_block", "labels")])
    df = df.withColumn("v", knn.integer_vector(F.col("embedding")))
    return sorted(tuple(r) for r in negatives.mine(df, df.filter(f"id % {every} = 0"), **options).collect())


@pytest.mark.parametrize(("kind", "block"), [("random", 50), ("hot label", 16), ("many labels", 40), ("hot vector", 30), ("random", 2048)])
def test_against_loops(spark, kind, block):
    rng = random.Random(len(kind) + block)
    rows = []
    for i in range(300):
        label = {"hot label": 0 if i % 3 else i % 4, "many labels": rng.randrange(120)}.get(kind, rng.randrange(4))
        v = [0.3 + rng.gauss(0, 0.4) for _ in range(10)]
        rows.append((i, [0.5] * 10 if kind == "hot vector" and i % 3 == 0 else v, label))
    rng.shuffle(rows)
    got = found(spark, rows, block=block)
    assert got and got == brute(rows, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (5, [1.0, 1.5], 1), (5, [1.0, 1.5], 1), (1, [1.0, 1.0], 2), (2, None, 1), (3, [nan, 1.0], 2), (4, [inf, 0.0], 1), (None, [1.0, 1.0], 2), (6, [None, 1.0], 1),
        (7, [1.0, 1.0], None), (8, [1.0], 3), (9, [], 2), (10, [-1.0, -1.0], 1), (11, [0.5, 1.0], 2), (12, [0.5, 1.0], 2), (13, [0.5, 1.0], 3),
    ]
    assert found(spark, rows) == brute(rows, 5) != []
    assert found(spark, []) == [] and found(spark, [(0, [1.0], 1)]) == [] and found(spark, [(1, [1.0], 1)]) == []
    assert found(spark, [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)]) == [(0, 1, 1, 2, 0, 0)]
