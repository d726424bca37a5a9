"""Blocks of samples in the distance operators: exact results, and no row is copied for other blocks."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import distance, permanova

SCHEMA = "sample_id string, feature_id string, count bigint"


def some_counts(samples, features, filled, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"s{i}", f"f{j}", int(rng.integers(1, 300))) for i in range(samples) for j in range(features) if j == 0 or rng.random() < filled]
    return rows


def brute(rows):
    table = {}
    for s, f, c in rows:
        table.setdefault(s, {})[f] = c
    sizes = {s: sum(t.values()) for s, t in table.items()}
    return {
        (a, b): (sum(min(c, table[b].get(f, 0)) for f, c in table[a].items()), sizes[a] + sizes[b])
        for a, b in itertools.combinations(sorted(table), 2)
    }


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# F2, F3 and F12


@pytest.mark.parametrize("filled", [0.9, 0.05])
@pytest.mark.parametrize("layout", [(1, 1), (5, 1), (4, 3)])
def test_shared_counts_of_full_and_of_sparse_features(spark, filled, layout):
    rows = some_counts(40, 30, filled, 3)
    got = distance.shared_counts(spark.createDataFrame(rows, SCHEMA), layout=layout).collect()
    assert len(got) == 40 * 39 // 2
    assert {(r["sample_a"], r["sample_b"]): (r["shared"], r["both"]) for r in got} == brute(rows)


def test_no_row_is_copied_for_other_blocks(spark):
    df = spark.createDataFrame(some_counts(30, 10, 0.5, 4), SCHEMA)
    text = plan(distance.bray_curtis(df, layout=(10, 1)))
    assert "Generate" not in text and "Aggregate" not in text


def test_large_tables_have_large_blocks(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("sample_id"), F.lit("f").alias("feature_id"), F.lit(1).alias("count"))
    assert distance._layout(df, [], 128) == (8, 1)


def test_pairs_of_rare_features_come_in_pieces(monkeypatch):
    monkeypatch.setattr(distance, "_PAIRS", 7)
    rows = some_counts(30, 40, 0.1, 5)
    rows = [r for r in rows if r[1] != "f0"]
    table = pa.table(
        {
            "sample_id": [r[0] for r in rows],
            "_run": pa.array([0] * len(rows), pa.int32()),
            "_code": [int(r[1][1:]) for r in rows],
            "count": [r[2] for r in rows],
            "_size": [r[2] for r in rows],
        }
    )
    block = distance.Block.unpack(distance.Block.pack(table))
    total, both = block.shared(block, 0), block.both(block, 0)
    place = {s: i for i, s in enumerate(block.names)}
    assert {p: (total[place[p[0]], place[p[1]]], both[place[p[0]], place[p[1]]]) for p in brute(rows)} == brute(rows)


def test_counts_beyond_narrow_integers(spark):
    rows = [("a", "x", 2**33), ("b", "x", 2**33 + 5), ("c", "x", 40_000), ("c", "y", 1)]
    got = distance.shared_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["sample_a"], r["sample_b"]): (r["shared"], r["both"]) for r in got} == brute(rows)


def test_keys_stay_apart_and_may_be_null(spark):
    rows = [(k, *r) for k, seed in (("p", 6), (None, 7)) for r in some_counts(9, 6, 0.5, seed)]
    df = spark.createDataFrame(rows, "grp string, " + SCHEMA)
    for layout in ((1, 1), (4, 1), (3, 2)):
        got = distance.shared_counts(df, ["grp"], layout=layout).collect()
        for k in ("p", None):
            own = {(r["sample_a"], r["sample_b"]): (r["shared"], r["both"]) for r in got if r["grp"] == k}
            assert own == brute([r[1:] for r in rows if r[0] == k])


# F4 and F10


@pytest.mark.parametrize("mean", [distance.average_rarefied_distance, distance.average_rarefied_distance_by_cells])
def test_means_are_taken_inside_the_tiles(spark, mean, monkeypatch):
    rows = some_counts(20, 8, 0.7, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = mean(df, 40, 6, 2, block=4)
    assert "sample_b" not in "".join(line for line in plan(whole).splitlines() if "Aggregate" in line)
    got = {(r["sample_a"], r["sample_b"]): r["d"] for r in whole.collect()}
    monkeypatch.setattr(distance, "_ROWS_PER_BLOCK", 5)  # samples are cut into slices, whose sums meet in a table
    cut = {(r["sample_a"], r["sample_b"]): r["d"] for r in mean(df, 40, 6, 2, block=4).collect()}
    assert got.keys() == cut.keys() and len(got) > 100
    assert all(got[p] == pytest.approx(cut[p], abs=1e-12) for p in got)


# F17


@pytest.mark.parametrize("rows_per_block", [10**6, 5])
def test_nearest_control_keeps_candidates_only(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(distance, "_ROWS_PER_BLOCK", rows_per_block)
    rows = some_counts(60, 12, 0.6, 9)
    rows += [("t1", f, c) for s, f, c in rows if s == "s1"]  # equals s1: ties go to the smaller id
    df = spark.createDataFrame(rows, SCHEMA)
    controls = spark.createDataFrame([(s,) for s in ["t1"] + [f"s{i}" for i in range(20)]], "sample_id string")
    ids = {r[0] for r in controls.collect()}
    want = {}
    for (a, b), (shared, both) in brute(rows).items():
        for x, y in ((a, b), (b, a)):
            if x not in ids and y in ids:
                want.setdefault(x, []).append((round(1 - 2 * shared / both, 12), y))
    got = {r["sample_id"]: r["control"] for r in distance.nearest_control(df, controls).collect()}
    assert got == {s: min(v)[1] for s, v in want.items()}
    if rows_per_block > 5:
        others = df.select("sample_id").distinct().join(controls, "sample_id", "left_anti")
        assert distance._between(df, others, controls, 128, distance._nearest_tile).count() < 2 * len(want)


# F5 and F14


@pytest.mark.parametrize("block", [128, 4])
def test_permutations_of_counts_equal_those_of_stored_distances(spark, block):
    rows = some_counts(24, 8, 0.7, 10)
    df = spark.createDataFrame(rows, SCHEMA)
    members = [("x", f"s{i}", f"g{i % 3}") for i in range(24)] + [("y", f"s{i}", f"g{i % 2}") for i in range(0, 20, 2)] + [("z", "s3", "g0"), ("x", "absent", "g0")]
    members = spark.createDataFrame(members, "comparison string, sample_id string, grp string")
    want = permanova.permanova(distance.bray_curtis(df), members, 99, 4).collect()
    got = permanova.permanova_of_counts(df, members, 99, 4, block=block).collect()
    assert len(want) >= 2 and {r["comparison"]: r["p_value"] for r in got} == {r["comparison"]: r["p_value"] for r in want}
    for a, b in zip(sorted(want), sorted(got)):
        assert a["comparison"] == b["comparison"] and a["df"] == b["df"]
        assert [a[c] for c in ("f_model", "sums_of_sqs", "r2")] == pytest.approx([b[c] for c in ("f_model", "sums_of_sqs", "r2")], abs=1e-9)


def test_distances_between_counts_are_not_stored_for_permutations(spark, monkeypatch):
    df = spark.createDataFrame(some_counts(12, 5, 0.7, 11), SCHEMA)
    meta = spark.createDataFrame([(f"s{i}", "ab"[i % 2]) for i in range(12)], "sample_id string, grp string")
    monkeypatch.setattr(distance, "bray_curtis", None)
    out = permanova.pairwise_permanova(None, meta, "grp", permutations=19, abund=df).collect()
    assert [r["pairs"] for r in out] == ["a vs b"]
