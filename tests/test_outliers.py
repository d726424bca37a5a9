"""Influence against refits without a cell, replacement, filters against a search, regularised logarithms against a dense solve."""

import math

import numpy as np
import pytest

from test_chunkmodels import planted

from tallyweave.functions.distributions import f_quantile
from tallyweave.operators import chunkmodels, diffabund, outliers, regularised


def test_f_quantile():
    assert math.isclose(f_quantile(0.95, 1, 10), 4.9646, abs_tol=1e-3)
    assert math.isclose(f_quantile(0.99, 3, 20), 4.9382, abs_tol=1e-3)


def spoiled(spark, samples=40):
    abund, meta = planted(spark, 6, samples=samples)
    rows = [(r["sample_id"], r["feature_id"], r["count"]) for r in abund.collect() if (r["sample_id"], r["feature_id"]) != ("s01", "f20")]
    return spark.createDataFrame([*rows, ("s01", "f20", 60000)], "sample_id string, feature_id string, count bigint"), meta


@pytest.mark.parametrize(("block", "chunk"), [(1000, 1000), (7, 9)])
def test_planted_outlier_is_no_hit(spark, block, chunk):
    abund, meta = spoiled(spark)
    design, names = diffabund.factor_design(meta, "grp", ["a", "b"])
    before = {r["feature_id"]: r for r in chunkmodels.wald_tests(abund, design, names).collect()}
    after = {r["feature_id"]: r for r in outliers.wald_without_outliers(abund, design, names, block=block, chunk=chunk).collect()}
    assert abs(before["f20"]["log2fc"]) > 2 and abs(after["f20"]["log2fc"]) < 1
    assert after["f20"]["replaced"] == 1 and after["f20"]["padj"] > 0.05
    assert sum(r["replaced"] for r in after.values()) <= 3 and all(after[f]["padj"] < 1e-4 for f in ("f00", "f01", "f02", "f03"))


def test_few_replicates_give_no_p(spark):
    abund, meta = spoiled(spark, samples=12)
    design, names = diffabund.factor_design(meta, "grp", ["a", "b"])
    got = {r["feature_id"]: r for r in outliers.wald_without_outliers(abund, design, names).collect()}
    assert got["f20"]["unclear"] == 1 and got["f20"]["replaced"] == 0 and got["f20"]["p_value"] is None and got["f20"]["padj"] is None
    assert got["f00"]["padj"] is not None


def test_influence_equals_dense_arithmetic(spark):
    abund, meta = planted(spark, 8, features=6, samples=20)
    design, names = diffabund.factor_design(meta, "grp", ["a", "b"])
    ones = meta.selectExpr("sample_id", "1.0D AS size_factor")
    tiles = chunkmodels.Tiles(abund, design, ones, 4, 7)
    disp = chunkmodels.dispersions(tiles, 2)
    got = {(r["sample_id"], r["feature_id"]): r["influence"] for r in outliers.influential(tiles, disp, 2, -1.0).collect()}
    alpha = {r["feature_id"]: r["dispersion"] for r in disp.collect()}
    counts = {(r["sample_id"], r["feature_id"]): r["count"] for r in abund.collect()}
    group = np.arange(20) % 2
    assert len(got) == 20 * len(alpha)
    for f, a in alpha.items():
        k = np.array([counts.get((f"s{s:02}", f), 0) for s in range(20)], float)
        mu = np.array([k[group == g].mean() for g in group])
        w = mu / (1 + a * mu)
        for s in range(20):
            others = np.arange(20) != s
            h = w[s] / w[group == group[s]].sum()
            residual = sum(((k[others & (group == g)] - k[others & (group == g)].mean()) ** 2).sum() for g in (0, 1))
            m = k[others].mean()
            alone = max((residual / 17 - m) / m**2, 0.04)
            want = (k[s] - mu[s]) ** 2 / (mu[s] + alone * mu[s] ** 2) * h / (1 - h) ** 2 / 2
            assert math.isclose(got[f"s{s:02}", f], want, rel_tol=1e-4, abs_tol=1e-7), (f, s)


def test_trimmed_means(spark):
    rng = np.random.default_rng(2)
    values = rng.poisson(1.5, (5, 23))
    rows = [(f"s{s}", f"f{f}", int(values[f, s])) for f in range(5) for s in range(23) if values[f, s]]
    abund = spark.createDataFrame(rows, "sample_id string, feature_id string, count bigint")
    ones = spark.createDataFrame([(f"s{s}", 1.0) for s in range(23)], "sample_id string, size_factor double")
    for r in outliers.trimmed_means(abund, ones, 23).collect():
        assert math.isclose(r["trimmed"], np.sort(values[int(r["feature_id"][1:])])[4:19].mean(), abs_tol=1e-12)


def adjusted(p):
    order = np.argsort(p)
    out = np.empty(len(p))
    out[order] = np.minimum(np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1], 1)
    return out


def test_filter_equals_a_search(spark):
    rng = np.random.default_rng(3)
    mean = np.round(rng.gamma(1, 20, 400), 1)
    p = np.where((mean > 20) & (rng.random(400) < 0.5), rng.beta(0.3, 12, 400), rng.random(400))
    rows = [(f"f{i}", c, float(mean[i]), float(p[i]) if i % 17 else None) for i in range(400) for c in ("x", None)]
    results = spark.createDataFrame(rows, "feature_id string, coefficient string, base_mean double, p_value double")
    got = outliers.independent_filter(results).collect()
    keep = np.arange(400) % 17 != 0
    tried = [(int((adjusted(p[keep & (mean >= t)]) <= 0.1).sum()), -i, t) for i, t in enumerate(np.quantile(mean[keep], np.linspace(0, 0.95, 50)))]
    _, _, limit = max(tried)
    want = dict(zip(np.flatnonzero(keep & (mean >= limit)), adjusted(p[keep & (mean >= limit)])))
    assert len(got) == 800 and limit > mean.min()
    for r in got:
        i = int(r["feature_id"][1:])
        assert math.isclose(r["limit"], limit)
        assert (r["padj"] is None) == (i not in want) and (r["padj"] is None or math.isclose(r["padj"], want[i], rel_tol=1e-9))
    assert outliers.independent_filter(results.limit(0)).count() == 0


def dense_levels(k, s, a, weight):
    """All coefficients of one feature at once: the level, then each sample's deviation."""
    n = len(k)
    b = np.zeros(n + 1)
    b[0] = math.log((k / s).mean())
    x, penalty = np.hstack([np.ones((n, 1)), np.eye(n)]), np.append(0.0, np.full(n, weight))
    for _ in range(500):
        mu = s * np.exp(x @ b)
        g = x.T @ ((k - mu) / (1 + a * mu)) - penalty * b
        h = (x.T * (mu * (1 + a * k) / (1 + a * mu) ** 2)) @ x + np.diag(penalty)
        b = b + np.clip(np.linalg.solve(h, g), -1, 1)
    return (b[0] + b[1:]) / math.log(2)


@pytest.mark.parametrize(("block", "chunk"), [(1000, 1000), (4, 5)])
def test_regularised_log_equals_dense_solve(spark, block, chunk):
    abund, meta = planted(spark, 9, features=8, samples=14)
    design, names = diffabund.factor_design(meta, "grp", ["a", "b"])
    sizes = {f"s{s:02}": 0.6 + 0.07 * s for s in range(14)}
    factors = spark.createDataFrame(list(sizes.items()), "sample_id string, size_factor double")
    got = {(r["feature_id"], r["sample_id"]): r["value"] for r in regularised.regularised_log(abund, design, 2, factors, 0.7, block, chunk).collect()}
    alpha = {r["feature_id"]: r["dispersion"] for r in chunkmodels.dispersions(chunkmodels.Tiles(abund, design, factors, 1000, 1000), 2).collect()}
    counts = {(r["feature_id"], r["sample_id"]): r["count"] for r in abund.collect()}
    assert len(got) == len(alpha) * 14
    for f, a in alpha.items():
        k = np.array([counts.get((f, s), 0) for s in sorted(sizes)], float)
        want = dense_levels(k, np.array([sizes[s] for s in sorted(sizes)]), a, 1 / (0.7 * math.log(2) ** 2))
        assert np.allclose([got[f, s] for s in sorted(sizes)], want, atol=1e-6)


def test_low_counts_shrink_more(spark):
    rows = [(f"s{s}", f, int(m * (2 if s % 2 else 1) + d * (s % 3))) for f, m, d in (("low", 2, 1), ("mid", 40, 2), ("high", 4000, 40)) for s in range(12)]
    abund = spark.createDataFrame(rows, "sample_id string, feature_id string, count bigint")
    meta = spark.createDataFrame([(f"s{s}", "ab"[s % 2]) for s in range(12)], "sample_id string, grp string")
    design, names = diffabund.factor_design(meta, "grp", ["a", "b"])
    ones = meta.selectExpr("sample_id", "1.0D AS size_factor")
    value = {(r["feature_id"], r["sample_id"]): r["value"] for r in regularised.regularised_log(abund, design, 2, ones).collect()}
    spread = {f: value[f, "s3"] - value[f, "s0"] for f in ("low", "mid", "high")}
    assert 0 < spread["low"] < spread["mid"] < spread["high"] <= 1.001
