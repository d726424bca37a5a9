"""Permutations that every sample computes for itself."""

import itertools

import numpy as np
import pytest

from tallyweave.operators import permanova


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_ranks_are_permuted(n):
    for key in range(5):
        got = permanova.walked_ranks(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


@pytest.mark.parametrize(("n", "k"), [(4, 2), (6, 3), (7, 2)])
def test_labels_are_uniform(n, k):
    """Each choice of the k samples of the first group is as likely as any other."""
    runs = 20000
    key = permanova._mixed(np.repeat(np.arange(runs, dtype=np.uint64), n))
    ranks = permanova.walked_ranks(np.tile(np.arange(n), runs), np.full(n * runs, n), key).reshape(runs, n)
    sets, counts = np.unique(ranks < k, axis=0, return_counts=True)
    want = len(list(itertools.combinations(range(n), k)))
    chi2 = ((counts - runs / want) ** 2 / (runs / want)).sum()
    assert len(sets) == want and chi2 < want - 1 + 5 * np.sqrt(2 * (want - 1))


def table(spark, seed, n=12):
    rng = np.random.default_rng(seed)
    pts = np.concatenate([rng.normal(0, 1, (n // 2, 2)), rng.normal(0.6, 1, (n - n // 2, 2))])
    rows = [(f"s{i:02}", f"s{j:02}", float(np.linalg.norm(pts[i] - pts[j]))) for i in range(n) for j in range(i + 1, n)]
    members = [(c, f"s{i:02}", "x" if i < n // 2 else "y") for c in ("all", "most") for i in range(n if c == "all" else n - 3)]
    return spark.createDataFrame(rows, "sample_a string, sample_b string, d double"), spark.createDataFrame(members, "comparison string, sample_id string, grp string")


def test_results_do_not_depend_on_partitions(spark):
    dist, members = table(spark, 1)
    one = {r["comparison"]: r for r in permanova.permanova(dist, members, 1200, 3, walk=True, per_array=100).collect()}
    two = {r["comparison"]: r for r in permanova.permanova(dist.repartition(5), members.repartition(7), 1200, 3, walk=True, per_array=500, block=4).collect()}
    sorted_way = {r["comparison"]: r for r in permanova.permanova(dist, members, 1200, 3).collect()}
    for c in one:
        assert one[c]["p_value"] == two[c]["p_value"]
        for k in ("f_model", "r2", "sums_of_sqs"):
            assert one[c][k] == pytest.approx(two[c][k]) == pytest.approx(sorted_way[c][k])
        assert abs(one[c]["p_value"] - sorted_way[c]["p_value"]) < 0.05
