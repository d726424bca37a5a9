"""From counts to time-course views on averaged rarefied distances."""

import numpy as np

from tallyweave.operators import distance, permanova, timecourse


def course(spark):
    """Two rooms over three days; room ``b`` changes its composition on the last day, and its samples are ten times as deep."""
    rng = np.random.default_rng(1)
    base, moved = rng.dirichlet(np.ones(12)), rng.dirichlet(np.ones(12))
    counts, meta = [], []
    for room in "ab":
        for day in range(3):
            for i in range(5):
                s = f"{room}{day}{i}"
                meta.append((s, room, day))
                drawn = rng.multinomial(4000 if room == "b" else 400, moved if room == "b" and day == 2 else base)
                counts += [(s, f"f{f:02}", int(c)) for f, c in enumerate(drawn) if c]
    meta.append(("none", "a", 0))
    return (
        spark.createDataFrame(counts, "sample_id string, feature_id string, count bigint"),
        spark.createDataFrame(meta, "sample_id string, room string, day int"),
    )


def test_only_the_planted_change_is_found(spark):
    abund, meta = course(spark)
    pairs = timecourse.rarefied_course(abund, meta, "room", "day", iterations=4, permutations=199, seed=3)
    rows = {r["pairs"]: r for r in pairs.collect()}
    assert len(rows) == 15
    # both sets at one depth: a difference in reads alone is no difference
    same, changed = timecourse.within_day(pairs, ["a", "b"]).filter("day1 < 2").collect(), timecourse.within_day(pairs, ["a", "b"]).filter("day1 = 2").collect()
    assert all(r["fdr"] > 0.05 for r in same) and len(changed) == 1 and changed[0]["fdr"] < 0.05
    steps = {(r["room"], r["day2"]): r for r in timecourse.cumulative_change(pairs, [0, 1, 2]).collect()}
    assert steps["b", 2]["fdr"] < 0.05 and steps["b", 2]["f_model"] > 10 * steps["a", 2]["f_model"] and steps["b", 1]["fdr"] > 0.05
    want = permanova.pairwise_permanova(
        distance.average_rarefied_distance_by_cells(abund, None, 4, 3), meta.filter("sample_id <> 'none'"), "room", "day", permutations=199, seed=3, walk=True
    )
    assert {(r["pairs"], round(r["f_model"], 9), r["p_value"]) for r in want.collect()} == {(k, round(r["f_model"], 9), r["p_value"]) for k, r in rows.items()}
