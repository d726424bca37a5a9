"""Known results and properties of the statistical operators."""

import itertools
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import distributions as dist
from tallyweave.functions import ranking
from tallyweave.operators import contamination, diffabund, distance, diversity, models, ordination, permanova, rarefaction
from tallyweave.plans import catalogue

# Colony counts per gram of 41 birds by vaccine, one cleaned assay; and the published contrasts of
# their log10 values (estimate, standard error, t, adjusted p).
CFU = {
    "mock": [11, 9, 20, 20, 260, 10, 16, 8000, 12, 160, 8, 7, 200],
    "866": [400, 600, 400, 200, 7200, 19, 20, 1200, 2800, 40, 400, 15, 1600, 400],
    "AviPro": [1000, 5200, 96000, 56000, 3000, 20, 20, 700, 1800, 2000, 500, 800, 292000, 420],
}
CONTRASTS = {
    "mock - AviPro": (-1.685148385929, 0.384276914101, -4.385244921285, 2.659096033e-4),
    "mock - 866": (-0.886249192440, 0.384276914101, -2.306277478347, 0.039965085481),
    "AviPro - 866": (0.798899193489, 0.377093534643, 2.118570381337, 0.040722540253),
}


def abundance(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, feature_id string, count long")


def test_colonisation_contrasts(spark):
    rows = [(v, float(x)) for v, xs in CFU.items() for x in xs]
    df = spark.createDataFrame(rows, "Vaccine string, CFU double").withColumn("log10_CFU", F.log10("CFU"))
    out = models.pairwise_contrasts(df, "log10_CFU", "Vaccine", ["mock", "AviPro", "866"]).collect()
    assert len(out) == 3
    for r in out:
        est, se, t, p = CONTRASTS[r["contrast"]]
        assert r["df"] == 38
        assert r["estimate"] == pytest.approx(est, abs=1e-9)
        assert r["std_error"] == pytest.approx(se, abs=1e-9)
        assert r["statistic"] == pytest.approx(t, abs=1e-8)
        assert r["adj_p_value"] == pytest.approx(p, rel=1e-8)


def test_distribution_functions():
    assert dist.t_two_sided([2.0], [10.0])[0] == pytest.approx(0.07338803, abs=1e-7)
    assert dist.t_quantile(0.975, [10.0])[0] == pytest.approx(2.228138852, abs=1e-7)
    assert dist.gamma_upper([0.5], [1.920729])[0] == pytest.approx(0.05, abs=1e-6)
    assert dist.beta_inc([2.0], [3.0], [0.4])[0] == pytest.approx(0.5248, abs=1e-10)


def test_adjusted_p_values(spark):
    rng = random.Random(3)
    ps = [round(rng.random() ** 3, 3) for _ in range(200)] + [0.0, 1.0, 1.0]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
    got = {r["i"]: r["p_adjusted"] for r in ranking.benjamini_hochberg(df, "p").collect()}
    order = sorted(range(len(ps)), key=lambda i: ps[i], reverse=True)
    low, want = 1.0, {}
    for back, i in enumerate(order):
        low = min(low, ps[i] * len(ps) / (len(ps) - back))
        want[i] = low
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) and got[i] >= ps[i] - 1e-15 for i in want)


def test_exact_quantiles(spark):
    rng = random.Random(4)
    rows = [("hot", rng.choice([-1, 0, 1]) * rng.expovariate(0.01)) for _ in range(500)] + [("one", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in ranking.quantiles(df, ["k"], "v", [0.1, 0.5, 0.9], ["a", "b", "c"]).collect()}
    want = np.quantile([v for k, v in rows if k == "hot"], [0.1, 0.5, 0.9])
    assert [got["hot"][c] for c in "abc"] == pytest.approx(list(want))
    assert [got["one"][c] for c in "abc"] == [2.5, 2.5, 2.5]


def test_global_index(spark):
    rows = [(i % 7, f"k{i:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b string")
    got = ranking.global_index(df, [F.col("a").desc(), F.col("b").asc()]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(1, 301))
    assert [(r["a"], r["b"]) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1]))


def test_richness_by_hand(spark):
    counts = [1, 1, 1, 2, 2, 5, 12]
    got = diversity.richness(abundance(spark, [("s", f"f{i}", c) for i, c in enumerate(counts)])).first()
    n = sum(counts)
    p = [c / n for c in counts]
    assert got["observed"] == 7
    assert got["chao1"] == pytest.approx(7 + 3 * 2 / (2 * 3))
    assert got["shannon"] == pytest.approx(-sum(x * math.log(x) for x in p))
    assert got["simpson"] == pytest.approx(1 - sum(x * x for x in p))
    cover = 1 - 3 / 12
    gamma = max(6 * (2 * 2 + 5 * 4 * 1) / (cover * 12 * 11) - 1, 0)
    assert got["ace"] == pytest.approx(1 + 6 / cover + 3 / cover * gamma)
    assert got["fisher"] * math.log(1 + n / got["fisher"]) == pytest.approx(7)


def test_ace_error_is_the_numeric_gradient(spark):
    counts = [1] * 6 + [2] * 4 + [3, 3, 5, 7, 10, 30, 41]

    def ace(a):
        rare = sum(a)
        n = sum(i * v for i, v in enumerate(a, 1))
        cover = 1 - a[0] / n
        gamma = max(rare * sum(i * (i - 1) * v for i, v in enumerate(a, 1)) / (cover * n * (n - 1)) - 1, 0)
        return 2 + rare / cover + a[0] / cover * gamma

    base = [counts.count(i) for i in range(1, 11)]
    value, grad = ace(base), []
    for i in range(10):
        up, down = list(base), list(base)
        up[i] += 1e-5
        down[i] -= 1e-5
        grad.append((ace(up) - ace(down)) / 2e-5)
    var = sum(a * g * g for a, g in zip(base, grad)) - sum(a * g for a, g in zip(base, grad)) ** 2 / value
    got = diversity.richness(abundance(spark, [("s", f"f{i}", c) for i, c in enumerate(counts)])).first()
    assert got["ace"] == pytest.approx(value)
    assert got["se_ace"] == pytest.approx(math.sqrt(var), rel=1e-5)


def random_abundance(spark, seed=1, samples=9, features=14):
    rng = random.Random(seed)
    rows = [(f"s{i}", f"f{j}", rng.randint(0, 30)) for i in range(samples) for j in range(features)]
    rows += [("s0", "huge", 70_000), ("s1", "huge", 5)]
    return [r for r in rows if r[2] > 0]


def test_rarefied_depth_and_partition_independence(spark):
    rows = random_abundance(spark)
    df = abundance(spark, rows)
    for thin in (rarefaction.rarefy(df, 60, 3), rarefaction.rarefy_with_replacement(df, 60, 3)):
        sums = {r[0]: r[1] for r in thin.groupBy("sample_id").agg(F.sum("count")).collect()}
        assert len(sums) == 9 and set(sums.values()) == {60}
    again = sorted(map(tuple, rarefaction.rarefy(df.repartition(5), 60, 3).collect()))
    assert again == sorted(map(tuple, rarefaction.rarefy(df.coalesce(1), 60, 3).collect()))
    limits = {(s, f): c for s, f, c in rows}
    assert all(c <= limits[s, f] for s, f, c in again)
    shallow = rarefaction.rarefy(df, 300).select("sample_id").distinct().collect()
    assert {"s0"} == {r[0] for r in shallow if r[0] == "s0"}


@pytest.mark.parametrize("block,slices", [(128, 1), (2, 1), (3, 4)])
def test_bray_curtis_brute_force(spark, block, slices):
    rows = random_abundance(spark, 2)
    table = {}
    for s, f, c in rows:
        table.setdefault(s, {})[f] = c
    layout = (max(1, math.ceil(len(table) / block)), slices)
    got = {(r["sample_a"], r["sample_b"]): r["d"] for r in distance.bray_curtis(abundance(spark, rows), layout=layout).collect()}
    assert set(got) == set(itertools.combinations(sorted(table), 2))
    for (a, b), d in got.items():
        shared = sum(min(c, table[b].get(f, 0)) for f, c in table[a].items())
        want = 1 - 2 * shared / (sum(table[a].values()) + sum(table[b].values()))
        assert d == pytest.approx(want, abs=1e-12) and 0 <= d <= 1


def test_distance_of_equal_and_disjoint_samples(spark):
    df = abundance(spark, [("a", "x", 3), ("b", "x", 3), ("c", "y", 4)])
    got = {(r[0], r[1]): r[2] for r in distance.bray_curtis(df).collect()}
    assert got == {("a", "b"): 0.0, ("a", "c"): 1.0, ("b", "c"): 1.0}


@pytest.mark.parametrize("block", [256, 3])
def test_permanova_against_numpy(spark, block):
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(0, 1, (6, 2)), rng.normal(1.5, 1, (5, 2))])
    names = [f"s{i:02d}" for i in range(11)]
    d = {(names[i], names[j]): float(np.linalg.norm(pts[i] - pts[j])) for i in range(11) for j in range(i + 1, 11)}
    dist_df = spark.createDataFrame([(a, b, v) for (a, b), v in d.items()], "sample_a string, sample_b string, d double")
    members = spark.createDataFrame([("c", n, "g1" if i < 6 else "g2") for i, n in enumerate(names)], "comparison string, sample_id string, grp string")
    got = permanova.permanova(dist_df, members, permutations=199, seed=2, block=block, per_array=50).first()
    total = sum(v * v for v in d.values()) / 11
    within = sum(sum(d[p] ** 2 for p in itertools.combinations(names[a:b], 2)) / (b - a) for a, b in ((0, 6), (6, 11)))
    assert got["f_model"] == pytest.approx((total - within) / (within / 9), abs=1e-8)
    assert got["r2"] == pytest.approx((total - within) / total)
    assert 1 / 200 <= got["p_value"] < 0.2


def test_dispersion_equals_euclidean_centroid_distance(spark):
    rng = np.random.default_rng(6)
    pts = rng.normal(size=(7, 3))
    rows = [(f"s{i}", f"s{j}", float(np.linalg.norm(pts[i] - pts[j]))) for i in range(7) for j in range(i + 1, 7)]
    df = spark.createDataFrame(rows, "sample_a string, sample_b string, d double")
    meta = spark.createDataFrame([(f"s{i}", "g") for i in range(7)], "sample_id string, grp string")
    got = {r["sample_id"]: r["distance"] for r in permanova.dispersion(df, meta, "grp").collect()}
    want = np.linalg.norm(pts - pts.mean(axis=0), axis=1)
    assert [got[f"s{i}"] for i in range(7)] == pytest.approx(list(want))


@pytest.mark.parametrize(("features", "width"), [(10, 8), (60, 2), (1200, 8), (3, 8)])
def test_ordination_equals_the_exact_decomposition(spark, features, width):
    rng = np.random.default_rng(8)
    counts = rng.poisson(rng.gamma(0.3, 4, (25, features))) + (rng.random((25, features)) < 0.02)
    counts[:, 0] += 1
    rows = [(f"s{i:02d}", f"f{j:04d}", int(c)) for (i, j), c in np.ndenumerate(counts) if c]
    got = {r["sample_id"]: (r["axis1"], r["axis2"]) for r in ordination.ordinate(abundance(spark, rows), width=width).collect()}
    values = np.sqrt(counts / counts.sum(axis=1, keepdims=True))
    u, d, v = np.linalg.svd(values - values.mean(axis=0), full_matrices=False)
    for j in range(2):
        want = u[:, j] * d[j] * np.sign(v[j][np.abs(v[j]).argmax()])
        assert [got[f"s{i:02d}"][j] for i in range(25)] == pytest.approx(list(want), abs=1e-7)


def test_ordination_that_does_not_settle_is_an_error(spark):
    rows = random_abundance(spark, 3, 20, 60)
    with pytest.raises(RuntimeError):
        ordination.ordinate(abundance(spark, rows), width=2, rounds=1)


def test_members_without_distances_do_not_count(spark):
    d = {("a", "b"): 1.0, ("a", "c"): 4.0, ("a", "d"): 5.0, ("b", "c"): 4.5, ("b", "d"): 4.0, ("c", "d"): 1.5}
    dist_df = spark.createDataFrame([(a, b, v) for (a, b), v in d.items()], "sample_a string, sample_b string, d double")
    rows = [("t", "a", "x"), ("t", "b", "x"), ("t", "c", "y"), ("t", "d", "y")]
    schema = "comparison string, sample_id string, grp string"
    want = permanova.permanova(dist_df, spark.createDataFrame(rows, schema), 19).first()
    assert permanova.permanova(dist_df, spark.createDataFrame([*rows, ("t", "lost", "y")], schema), 19).first() == want
    meta = spark.createDataFrame([("a", "x"), ("b", "x"), ("lost", "x")], "sample_id string, grp string")
    got = {r["sample_id"]: r["distance"] for r in permanova.dispersion(dist_df, meta, "grp").collect()}
    assert got == {"a": pytest.approx(0.5), "b": pytest.approx(0.5)}


def test_pairs_of_groups_with_alike_names(spark):
    meta = spark.createDataFrame([("a", "u", "v_w"), ("b", "u_v", "w"), ("c", "u", None), ("d", "u", "v_w")], "sample_id string, g string, h string")
    pairs, members = permanova.pairwise_members(meta, "g", "h")
    assert pairs.count() == 3 and pairs.select("comparison").distinct().count() == 3
    sizes = sorted(r["count"] for r in members.groupBy("comparison").count().collect())
    assert sizes == [2, 3, 3]


def test_null_families_are_families(spark):
    df = spark.createDataFrame([(None, "x", 0.01), (None, "x", 0.04), ("a", None, 0.02), ("a", "x", 0.5), ("a", "x", None)], "f string, g string, p double")
    got = {(r["f"], r["g"], r["p"]): r["q"] for r in ranking.benjamini_hochberg(df, "p", ["f", "g"], "q").collect()}
    assert got == {(None, "x", 0.01): 0.02, (None, "x", 0.04): 0.04, ("a", None, 0.02): 0.02, ("a", "x", 0.5): 0.5, ("a", "x", None): None}
    got = {(r["f"], r["g"], r["p"]): r["q"] for r in ranking.bonferroni(df, "p", ["f", "g"], "q").collect()}
    assert got[None, "x", 0.04] == 0.08 and got["a", None, 0.02] == 0.02


def test_size_factors_must_be_chosen(spark):
    df = abundance(spark, [("a", "x", 3), ("b", "y", 4)])
    with pytest.raises(ValueError):
        diffabund.size_factors(df, "ratio")
    with pytest.raises(ValueError):
        diffabund.size_factors(df, "auto")
    assert diffabund.size_factors(df, "poscounts").count() == 2


def test_shrinkage_follows_its_quantile(spark):
    rows = [(f"f{i}", "c", float(i), 1.0) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "feature_id string, coefficient string, log2fc double, lfc_se double")
    for upper in (0.95, 0.5):
        width = np.quantile(np.arange(1, 101), upper) / NormalDist().inv_cdf((1 + upper) / 2)
        got = {r["feature_id"]: r["log2fc_shrunk"] for r in diffabund.shrink(df, upper).collect()}
        assert got["f50"] == pytest.approx(50 * width**2 / (width**2 + 1))


def test_profiles_against_numpy(spark):
    rng = np.random.default_rng(2)
    meta, values, table = [], [], np.full((6, 30), -1.0)
    for i in range(30):
        meta.append((f"s{i}", f"g{i % 3}", i // 3 % 4))
        for j in range(6):
            if rng.random() < 0.4:
                table[j, i] = rng.normal()
                values.append((f"s{i}", f"f{j}", float(table[j, i])))
    meta_df = spark.createDataFrame(meta, "sample_id string, grp string, day int")
    values_df = spark.createDataFrame(values, "sample_id string, feature_id string, value double")
    cells = diffabund.design_cells(meta_df, "grp", "day")
    order = sorted({(g, d) for _, g, d in meta})
    assert [(r["group"], r["time"]) for r in cells.orderBy("cell").collect()] == order
    got = {r["feature_id"]: r["profile"] for r in diffabund.profiles(values_df, meta_df, "grp", "day", cells).collect()}
    for j in range(6):
        m = np.array([table[j, [i for i, x in enumerate(meta) if x[1:] == c]].mean() for c in order])
        assert got[f"f{j}"] == pytest.approx(list((m - m.mean()) / m.std(ddof=1)))


def test_contaminants_by_hand(spark):
    meta = spark.createDataFrame([(f"n{i}", True) for i in range(4)] + [(f"e{i}", False) for i in range(20)], "sample_id string, is_neg boolean")
    rows = [(f"n{i}", "bad", 3) for i in range(4)] + [("e0", "bad", 1)]
    rows += [(f"e{i}", "good", 5) for i in range(20)] + [("n0", "once", 1)]
    rows += [(s, "everywhere", 1) for s in [f"n{i}" for i in range(4)] + [f"e{i}" for i in range(20)]]
    got = {r["feature_id"]: r for r in contamination.prevalence_scores(abundance(spark, rows), meta).collect()}
    only = math.comb(5, 4) * math.comb(19, 0) / math.comb(24, 4)
    assert got["bad"]["p"] == pytest.approx(only / 2) and got["bad"]["contaminant"]
    assert not got["good"]["contaminant"]
    assert got["once"]["p"] is None and not got["once"]["contaminant"]
    assert got["everywhere"]["p"] == 0.5


def planted(spark, seed=9):
    rng = np.random.default_rng(seed)
    meta, rows = [], []
    for i in range(24):
        g, day = ("ref", "alt")[i % 2], i // 2 % 4
        meta.append((f"s{i:02d}", g, day))
        depth = rng.uniform(0.5, 2)
        for j in range(40):
            mu = 30 * depth * (4.0 if j < 4 and g == "alt" else 1.0) * (2.5 ** day if 4 <= j < 8 and g == "alt" else 1.0)
            c = int(rng.poisson(rng.gamma(8, mu / 8)))
            if c:
                rows.append((f"s{i:02d}", f"f{j:02d}", c))
    return abundance(spark, rows), spark.createDataFrame(meta, "sample_id string, grp string, day int")


def test_wald_finds_planted_features(spark):
    abund, meta = planted(spark)
    design, names = diffabund.factor_design(meta, "grp", ["ref", "alt"])
    out = diffabund.shrink(diffabund.wald_tests(abund, design, names)).collect()
    found = {r["feature_id"]: r for r in out}
    assert len(found) == 40
    for j in range(4):
        r = found[f"f{j:02d}"]
        assert r["padj"] < 0.01 and 1.2 < r["log2fc"] < 3.0
        assert 0 < r["log2fc_shrunk"] <= r["log2fc"]
    calm = [found[f"f{j:02d}"]["padj"] > 0.05 for j in range(8, 40)]
    assert sum(calm) >= 29


def test_ratio_test_finds_diverging_features(spark):
    abund, meta = planted(spark)
    design, names, reduced = diffabund.interaction_design(meta, "grp", ["ref", "alt"], "day")
    out = {r["feature_id"]: r["padj"] for r in diffabund.likelihood_ratio_tests(abund, design, names, reduced).collect()}
    assert all(out[f"f{j:02d}"] < 0.01 for j in range(4, 8))
    assert sum(out[f"f{j:02d}"] > 0.05 for j in range(8, 40)) >= 29


def test_profiles_cluster_by_shape(spark):
    rows = [(f"up{i}", [-1.0, 0.0, 1.0]) for i in range(8)] + [(f"down{i}", [1.0, 0.0, -1.0]) for i in range(7)] + [("odd", [-0.6, 1.2, -0.6])]
    df = spark.createDataFrame(rows, "feature_id string, profile array<double>")
    got = diffabund.pattern_clusters(df, k=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["cluster"], set()).add(r["feature_id"][:2])
    assert sorted(map(sorted, by.values())) == [["do"], ["up"]]


def test_trial_catalogue_cell_sizes(spark):
    sizes = {  # birds per (vaccine, challenge, day)
        **{("Mock", "Mock", d): n for d, n in ((-1, 4), (2, 12), (7, 12), (14, 12), (21, 16))},
        **{("Mock", "Reading", d): n for d, n in ((-1, 8), (2, 12), (7, 12), (14, 12), (21, 16))},
        **{("BBS866", "Reading", d): n for d, n in ((-1, 12), (2, 12), (7, 12), (14, 12), (21, 16))},
        **{("AVIPRO", "Reading", d): n for d, n in ((-1, 10), (2, 12), (7, 12), (14, 12), (21, 13))},
        ("Mock", "Infantis", 10): 13, ("BBS866", "Infantis", 10): 14, ("AVIPRO", "Infantis", 10): 14,
    }
    rows = [(f"{v}{c}{d}_{i}", v, c, d) for (v, c, d), n in sizes.items() for i in range(n)]
    meta = spark.createDataFrame(rows, "sample_id string, vaccine string, challenge string, day int")
    comparisons = catalogue.trial_catalogue()
    assert len(comparisons) == 18
    table = catalogue.as_table(spark, comparisons, "vaccine string, challenge string, day int")
    got = {}
    for r in catalogue.members(table, meta, ["vaccine", "challenge", "day"]).groupBy("comparison", "grp").count().collect():
        got.setdefault(r[0], {})[r[1]] = r[2]
    assert got["A1"] == {"Mock": 12, "BBS866": 12} and got["A2"] == {"Mock": 12, "AVIPRO": 10}
    assert got["A3"] == {"Mock": 12, "Vaccinated": 22} and got["B1"] == {"Mock": 12, "Infantis": 13}
    assert got["C1"] == {"Mock": 13, "BBS866": 14} and got["D1"] == {"Mock": 13, "AVIPRO": 14}
    assert got["E4"] == {"Mock": 16, "Reading": 16} and got["G4"] == {"Mock": 16, "AVIPRO": 13}
