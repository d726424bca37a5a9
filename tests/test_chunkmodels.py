"""Models from sums over chunks against models with whole designs, and the heavy-tailed posterior against a grid."""

import math

import numpy as np
import pytest

from tallyweave.operators import chunkmodels, diffabund


def planted(spark, seed=1, features=30, samples=40):
    rng = np.random.default_rng(seed)
    group, day = np.arange(samples) % 2, np.arange(samples) % 5
    rows = []
    for f in range(features):
        mean = rng.gamma(2, 10) * (8.0 if f < 4 else 1.0) ** group * (1.3 ** (day * group) if 4 <= f < 7 else 1.0)
        rows += [(f"s{s:02}", f"f{f:02}", int(c)) for s, c in enumerate(rng.negative_binomial(5, 5 / (5 + mean))) if c]
    abund = spark.createDataFrame(rows, "sample_id string, feature_id string, count bigint")
    meta = spark.createDataFrame([(f"s{s:02}", "ab"[group[s]], int(day[s])) for s in range(samples)], "sample_id string, grp string, day int")
    return abund, meta


def close(a, b, keys, names):
    x, y = ({tuple(r[k] for k in keys): r for r in d.collect()} for d in (a, b))
    assert set(x) == set(y) and len(x) > 20
    for k in x:
        for n in names:
            assert math.isclose(x[k][n], y[k][n], rel_tol=1e-5, abs_tol=1e-6), (k, n, x[k][n], y[k][n])


@pytest.mark.parametrize(("block", "chunk"), [(1000, 1000), (7, 9)])
def test_wald_equals_whole_designs(spark, block, chunk):
    abund, meta = planted(spark)
    design, names = diffabund.factor_design(meta, "grp", ["a", "b"])
    got = chunkmodels.wald_tests(abund, design, names, block=block, chunk=chunk)
    want = diffabund.wald_tests(abund, design, names)
    close(got, want, ["feature_id", "coefficient"], ["base_mean", "dispersion", "log2fc", "lfc_se", "p_value", "padj"])
    assert all(r["converged"] for r in got.collect()) and {r["feature_id"] for r in got.filter("padj < 1e-4").collect()} >= {"f00", "f01", "f02", "f03"}


def test_ratio_tests_equal_whole_designs(spark, monkeypatch):
    monkeypatch.setattr(chunkmodels, "_FAN", 2)  # several levels of sums
    abund, meta = planted(spark, 2)
    design, names, reduced = diffabund.interaction_design(meta, "grp", ["a", "b"], "day")
    got = chunkmodels.likelihood_ratio_tests(abund, design, names, reduced, block=11, chunk=8)
    close(got, diffabund.likelihood_ratio_tests(abund, design, names, reduced), ["feature_id"], ["statistic", "log2fc", "p_value", "padj"])


def test_tiles_do_not_grow_with_samples(spark):
    sizes = []
    for samples in (40, 160):
        abund, meta = planted(spark, 3, samples=samples)
        design, _ = diffabund.factor_design(meta, "grp", ["a", "b"])
        tiles = chunkmodels.Tiles(abund, design, None, 1000, 20)
        sizes.append(max(len(r["s"]) for r in tiles.tiles.collect()))
        assert sum(len(r["s"]) for r in tiles.tiles.collect()) == samples
    assert sizes[1] < 2 * 20 and sizes[0] < 2 * 20


def test_posterior_against_a_grid():
    rng = np.random.default_rng(4)
    lfc, se, scale = rng.normal(0, 3, 60), rng.gamma(2, 0.4, 60) + 0.05, rng.gamma(2, 0.3, 60) + 0.02
    mode, sd = chunkmodels.posterior(lfc, se, scale)
    for m, e, g, b, w in zip(lfc, se, scale, mode, sd):
        grid = np.linspace(min(m, 0) - 0.01, max(m, 0) + 0.01, 400001)
        cost = lambda t: 0.5 * ((t - m) / e) ** 2 + np.log1p((t / g) ** 2)
        assert cost(b) <= cost(grid).min() + 1e-9 and w > 0
        h = 1e-4
        bend = (cost(b + h) - 2 * cost(b) + cost(b - h)) / h**2
        assert bend <= 0 or math.isclose(w, 1 / math.sqrt(bend), rel_tol=1e-2)
    assert np.isnan(chunkmodels.posterior(np.array([np.nan, 1.0]), np.array([1.0, 0.0]), np.array([1.0, 1.0]))[0]).all()


def test_large_effects_keep_their_size(spark):
    rng = np.random.default_rng(5)
    lfc = np.concatenate([rng.normal(0, 0.3, 200), [6.0, -5.0]])
    rows = [(f"f{i}", "c", float(v), 0.3) for i, v in enumerate(lfc)]
    results = spark.createDataFrame(rows, "feature_id string, coefficient string, log2fc double, lfc_se double")
    heavy = {r["feature_id"]: r["log2fc_shrunk"] for r in chunkmodels.shrink_heavy_tailed(results).collect()}
    normal = {r["feature_id"]: r["log2fc_shrunk"] for r in diffabund.shrink(results).collect()}
    assert abs(heavy["f200"] - 6) < 0.1 and abs(heavy["f201"] + 5) < 0.1 and abs(normal["f200"] - 6) > 1
    small = [f"f{i}" for i in range(200)]
    assert np.mean([abs(heavy[f]) for f in small]) < 0.5 * np.mean(np.abs(lfc[:200]))
