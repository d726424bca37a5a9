"""A catalogue of comparisons: rare features go per comparison, and every comparison runs through explore."""

import numpy as np

from tallyweave.countset import CountSet
from tallyweave.plans import catalogue
from tallyweave.plans.catalogue import Comparison


def planted(spark):
    rng = np.random.default_rng(1)
    meta = [(f"s{i:02}", "ab"[i % 2], i // 10) for i in range(20)]
    rows = [(s, f"f{f}", int(c)) for s, g, d in meta for f, c in enumerate(rng.poisson(20 * np.where((np.arange(8) == 0) & (g == "b"), 6, 1))) if c]
    rows += [("s00", "rare", 50), ("s00", "few", 1), ("s01", "few", 1), ("s02", "few", 1), ("s10", "late", 9), ("s11", "late", 9), ("s12", "late", 9)]
    tax = [(f, f"p{f}") for f in {r[1] for r in rows}]
    return CountSet(
        spark.createDataFrame(rows, "sample_id string, feature_id string, count bigint"),
        spark.createDataFrame(meta, "sample_id string, grp string, day int"),
        spark.createDataFrame(tax, "feature_id string, phylum string"),
    )


def comparisons(**limits):
    return [Comparison(f"D{d}", "treat", (("a", (("a", d),)), ("b", (("b", d),))), **limits) for d in (0, 1)]


def test_rare_features_go_per_comparison(spark):
    cs = planted(spark)
    meta = cs.meta.withColumnRenamed("grp", "treatment")

    def kept(**limits):
        table = catalogue.as_table(spark, comparisons(**limits), "treatment string, day int")
        return {(r["comparison"], r["feature_id"]) for r in catalogue.pruned(table, cs.abund, meta, ["treatment", "day"]).collect()}

    everything = {(f"D{d}", f"f{f}") for d in (0, 1) for f in range(8)}
    assert kept() == everything | {("D0", "rare"), ("D0", "few"), ("D1", "late")}
    assert kept(min_total=3) == everything | {("D0", "rare"), ("D1", "late")}
    assert kept(min_prevalence=2) == everything | {("D0", "few"), ("D1", "late")}
    assert kept(min_total=3, min_prevalence=2) == everything | {("D1", "late")}


def test_catalogue_through_explore(spark):
    cs = planted(spark)
    cs = CountSet(cs.abund, cs.meta.withColumnRenamed("grp", "treatment"), cs.tax)
    run = catalogue.explore_all(cs, comparisons(min_prevalence=2), ["treatment", "day"], "treatment string, day int", parts=("permanova", "alpha_model", "differential"), permutations=99)
    assert set(run) == {"permanova", "alpha_model", "differential"}
    tests = {r["comparison"]: r for r in run["permanova"].collect()}
    assert set(tests) == {"D0", "D1"} and all(r["p_value"] <= 0.05 for r in tests.values())
    hits = {(r["comparison"], r["feature_id"]) for r in run["differential"].collect()}
    assert {("D0", "f0"), ("D1", "f0")} <= hits
    # the single job over all comparisons gives the same statistics
    counts = catalogue.pruned(catalogue.as_table(spark, comparisons(min_prevalence=2), "treatment string, day int"), cs.abund, cs.meta, ["treatment", "day"])
    for r in catalogue.permanova_all(counts, 99).collect():
        assert abs(r["f_model"] - tests[r["comparison"]]["f_model"]) < 1e-6


def test_nest_bounds_its_cells(spark):
    from tallyweave.operators import summaries

    rows = [("hot", i % 50, "same" if i % 3 else f"v{i}") for i in range(3000)] + [("hot", 1, "copy")] * 2000 + [("small", 7, None), (None, 1, "x")]
    df = spark.createDataFrame(rows, "room string, day int, value string")
    nested = summaries.nest(df, "room", size=100)
    cells = {(r["room"], r["cell"]): [tuple(x) for x in r["data"]] for r in nested.collect()}
    assert max(map(len, cells.values())) < 200 and sum(k[0] == "hot" for k in cells) == 50
    assert {(r["room"], r["cell"]): [tuple(x) for x in r["data"]] for r in summaries.nest(df.repartition(7), "room", size=100).collect()} == cells
    back = [tuple(r) for r in summaries.unnest(nested, "room").collect()]
    assert sorted(back, key=repr) == sorted(rows, key=repr)
