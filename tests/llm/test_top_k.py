"""Exact top-k inner products."""

import random

import pytest
from brute import top_k
from pyspark.sql import functions as F

from tallyweave.llm import knn


def found(spark, rows, every=5, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df = df.select(F.col("vec_id").alias("id"), knn.integer_vector(F.col("embedding")).alias("v"))
    out = knn.top_k(df, df.filter(f"id % {every} = 0"), **options)
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in out.collect())


@pytest.mark.parametrize("pivots", [1, 7, 64])
@pytest.mark.parametrize("kind", ["random", "clusters", "hot"])
def test_against_brute_force(spark, pivots, kind):
    rng = random.Random(pivots)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = []
    for i in range(400):
        c = rng.choice(centres) if kind != "random" else [0.0] * 8
        v = [x + rng.gauss(0, 0.05 if kind != "random" else 1) for x in c]
        rows.append((i, centres[0] if kind == "hot" and i % 3 == 0 else v))
    rng.shuffle(rows)
    assert found(spark, rows, k=5, pivots=pivots, group_limit=8, block=50) == top_k(spark_floats(rows), lambda q: q % 5 == 0, 5)


def spark_floats(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (None, [1.0, 1.0]), (10, [None, 1.0]), (7, [3.0, -1.0]), (8, [0.0, 0.0])]
    assert found(spark, rows, k=5) == top_k(rows, lambda q: q % 5 == 0, 5)
    assert found(spark, [(0, [1.0]), (1, [-2.0])], k=5) == [(0, 1, 1, -131072)]
    assert found(spark, [(0, [1.0, 1.0]), (1, [2.0]), (2, [])], k=5) == [(0, 1, 1, 131072), (0, 2, 2, 0)]


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**20, 1.0]), (2, [2.0**20, 1.0 + 2**-8]), (3, [-(2.0**20), 0.0])]
    assert found(spark, rows, k=3) == top_k(rows, lambda q: q % 5 == 0, 3)


def test_empty_tables(spark):
    assert found(spark, [], k=5) == [] and found(spark, [(1, [1.0])], k=5) == [] and found(spark, [(0, [1.0])], k=5) == []
