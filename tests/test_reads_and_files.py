"""Files, cleaning and read-level operators on small inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.countset import CountSet
from tallyweave.functions import columns as C
from tallyweave.operators import amplicon as A
from tallyweave.operators import cleaning, summaries
from tallyweave.sources import cache, delimited
from tallyweave.sources import reads as files


def uniques(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, seq string, count long")


def test_lab_sheet_with_broken_headers(spark, tmp_path):
    path = tmp_path / "sheet.txt"
    path.write_bytes(
        b'Turkey ID#\tVaccine\t"PBS \n(mL)"\t"# Sal. Col. \nin 1 g"\tCFU/g\tNotes\r\n'
        b'1\t866 (SB 358)\t0.5\t10\t\t\r\n2\tmock\t\tNA\t12.5\tfine\r\n'
    )
    df = delimited.read_lab_sheet(spark, str(path), {"Turkey_ID": "int", "CFU_g": "double"})
    assert df.columns == ["Turkey_ID", "Vaccine", "PBS_mL", "Sal_Col_in_1_g", "CFU_g", "Notes"]
    rows = [tuple(r) for r in df.orderBy("Turkey_ID").collect()]
    assert rows == [(1, "866 (SB 358)", "0.5", "10", None, None), (2, "mock", None, None, 12.5, "fine")]
    vaccine = df.select(C.replace_first("Vaccine", r" \(SB 358\)", "")).collect()
    assert sorted(r[0] for r in vaccine) == ["866", "mock"]


def test_fastq_split_over_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for mate in (1, 2):
        lines = []
        for i in range(400):
            seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(20, 60)))
            qual = "".join(rng.choice("@+!IJ#") for _ in seq)  # quality lines may start like headers
            want[f"r{i}", mate] = (seq, [ord(c) - 33 for c in qual])
            lines += [f"@r{i} extra", seq, "+", qual]
        (tmp_path / f"S7_L001_R{mate}_001.fastq").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.read_fastq(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["sample_id"] for r in got} == {"S7"}
    assert {(r["read_id"], r["mate"]): (r["seq"], r["qual"]) for r in got} == want


def test_compute_once_ignores_unfinished_output(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cache.compute_once(spark, str(tmp_path), "t", {"a": 1}, build).count() == 3
    assert len(calls) == 1
    cache.compute_once(spark, str(tmp_path), "t", {"a": 2}, build)
    assert len(calls) == 2
    source = str(tmp_path / "in")
    for rows in (5, 6, 6):
        if len(calls) < 4:
            spark.range(rows).write.mode("overwrite").parquet(source)
        cache.compute_once(spark, str(tmp_path), "t", {}, build, [spark.read.parquet(source)])
    assert len(calls) == 4


def test_nested_cells_do_not_depend_on_size(spark):
    df = spark.range(5000).select(F.lit("k").alias("key"), F.lit(1).alias("v")).union(spark.range(3).select(F.lit("l"), F.lit(2)))
    for cells in (1, 4):
        got = {(r["key"], r["cell"]): len(r["data"]) for r in summaries.nest(df.coalesce(1), "key", cells).collect()}
        assert {c for k, c in got if k == "k"} == set(range(cells)) and max(got.values()) <= 5000 / cells + 1
        assert summaries.unnest(summaries.nest(df, "key", cells), "key").count() == 5003


def test_lineage_backfill(spark):
    rows = [("x", None, None, "c", None, None, None, None), ("y", "d", "p", None, None, "f", None, "s")]
    df = spark.createDataFrame(rows, "id string, domain string, phylum string, class string, `order` string, family string, genus string, species string")
    got = {r["id"]: [r[k] for k in C.RANKS] for r in C.backfill_lineage(df).collect()}
    assert got["x"] == ["unclassified", "unclassified", "c", "c_unclassified", "c_unclassified", "c_unclassified", "c_unclassified"]
    assert got["y"] == ["d", "p", "p_unclassified", "p_unclassified", "f", "f_unclassified", "s"]


@pytest.mark.parametrize("x,want", [(0.0123456, 0.012), (123456.0, 120000.0), (-0.0095, -0.0095), (0.0, 0.0), (1.25e-9, 1.3e-9)])
def test_significant(spark, x, want):
    df = spark.createDataFrame([(x,)], "x double")
    assert C.significant_all(df).first()["x"] == pytest.approx(want, rel=1e-9, abs=1e-30)


def test_duplicate_assay_key_is_an_error(spark):
    meta = spark.createDataFrame([("s1", "1")], "sample_id string, bird string")
    assay = spark.createDataFrame([("1", 2.0), ("1", 3.0)], "bird string, cfu double")
    out = cleaning.attach_assay(meta, assay, [F.col("bird")], [F.col("bird")], ["cfu"])
    with pytest.raises(Exception, match="duplicate assay key"):
        out.collect()


def test_merge_does_not_double_shared_samples(spark):
    abund = spark.createDataFrame([("a", "f", 2), ("b", "f", 3)], "sample_id string, feature_id string, count long")
    meta = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, k int")
    tax = spark.createDataFrame([("f", "d")], "feature_id string, domain string")
    cs = CountSet.aligned(abund, meta, tax)
    merged = cs.merge(cs.keep_samples(F.col("k") == 1))
    assert sorted(map(tuple, merged.abund.collect())) == [("a", "f", 2), ("b", "f", 3)]
    assert merged.meta.count() == 2 and merged.tax.count() == 1
    changed = spark.createDataFrame([("a", 9)], "sample_id string, k int")
    for other in (CountSet(abund.filter("sample_id = 'a'"), changed, tax), CountSet(abund.withColumn("count", F.lit(9).cast("long")), meta, tax)):
        with pytest.raises(ValueError, match="disagree"):
            cs.merge(other)


def test_filter_needs_both_mates(spark):
    good, low = [30] * 10, [30] * 4 + [2] + [30] * 5
    rows = [
        ("s", "ok", 1, "ACGTACGTAC", good), ("s", "ok", 2, "ACGTACGTAC", good),
        ("s", "short", 1, "ACGTACGTAC", low), ("s", "short", 2, "ACGTACGTAC", good),
        ("s", "n", 1, "ACGNACGTAC", good), ("s", "n", 2, "ACGTACGTAC", good),
        ("s", "ee", 1, "ACGTACGTAC", [3] * 10), ("s", "ee", 2, "ACGTACGTAC", good),
    ]
    df = spark.createDataFrame(rows, "sample_id string, read_id string, mate int, seq string, qual array<int>")
    got = A.filter_and_trim(df, {1: 8, 2: 6}).collect()
    assert {(r["read_id"], r["mate"], r["seq"], len(r["qual"])) for r in got} == {("ok", 1, "ACGTACGT", 8), ("ok", 2, "ACGTAC", 6)}
    untouched = A.filter_and_trim(df).filter("read_id = 'short'").collect()
    assert {(r["mate"], len(r["seq"])) for r in untouched} == {(1, 4), (2, 10)}


def test_merge_pairs_takes_longest_exact_overlap(spark):
    amplicon = "ACGTTGCAAGGCTTACCGATGGATCCA"
    back = amplicon[8:][::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [("s", "a", 1, amplicon[:22], None), ("s", "a", 2, back, None), ("s", "b", 1, "ACGT", None), ("s", "b", 2, "ACGT", None)]
    df = spark.createDataFrame(rows, "sample_id string, read_id string, mate int, seq string, qual array<int>")
    got = A.merge_pairs(df).collect()
    assert [(r["read_id"], r["seq"], r["overlap"]) for r in got] == [("a", amplicon, 14)]


def test_denoise_follows_chains(spark):
    rows = [("s", "AAAAAA", 100), ("t", "AAAAAT", 20), ("s", "AAAATT", 5), ("s", "CCCCCC", 9), ("s", "CCCCCG", 6), ("s", "AAAAA", 1)]
    got = {(r[0], r[1]): r[2] for r in A.denoise(uniques(spark, rows)).collect()}
    assert got == {("s", "AAAAAA"): 105, ("t", "AAAAAA"): 20, ("s", "CCCCCC"): 9, ("s", "CCCCCG"): 6, ("s", "AAAAA"): 1}
    steps = [("s", "AAAA", 100), ("s", "AAAC", 10), ("s", "AACC", 2)]
    assert [tuple(r) for r in A.denoise(uniques(spark, steps)).collect()] == [("s", "AAAA", 112)]
    letters = ["A" * (40 - i) + "C" * i for i in range(12)]
    chain = [("s", q, 2 ** (30 - 2 * i)) for i, q in enumerate(letters)]
    found = {r["seq"]: r["variant"] for r in A.variants(uniques(spark, chain)).collect()}
    assert found == {q: letters[0] for q in letters[1:]}
    with pytest.raises(ValueError):
        A.denoise(uniques(spark, rows), ratio=1.0)


def test_reads_take_the_letters_of_their_variant(spark):
    rows = [("s", f"r{i}", m, "ACGTA", [30] * 5) for i in range(10) for m in (1, 2)] + [("s", "e", 1, "ACGTT", [7] * 5), ("s", "e", 2, "GGGGG", [7] * 5)]
    df = spark.createDataFrame(rows, "sample_id string, read_id string, mate int, seq string, qual array<int>")
    got = {(r["read_id"], r["mate"]): (r["seq"], r["qual"]) for r in A.corrected(df).collect()}
    assert len(got) == 22 and got["e", 1] == ("ACGTA", [7] * 5) and got["e", 2] == ("GGGGG", [7] * 5)


def test_contaminants_on_either_strand(spark):
    genome = "ACGGTTACAGGATTTCCAGGCATTAGCCAGTA"
    other = genome[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [("s", "same", 1, genome[4:28]), ("s", "back", 1, other[3:27]), ("s", "far", 1, "A" * 24)]
    df = spark.createDataFrame(rows, "sample_id string, read_id string, mate int, seq string")
    hits = A.contaminant_hits(df, spark.createDataFrame([(genome,)], "seq string"), 12)
    assert {r["read_id"] for r in hits.collect()} == {"same", "back"}


def test_parents_brute_force(spark):
    rng = random.Random(2)
    pool = {"".join(rng.choice("AC") for _ in range(rng.choice([5, 6]))): rng.randint(1, 40) for _ in range(60)}
    got = {r["seq"]: r["parent"] for r in A.abundant_parents(uniques(spark, [("s", q, n) for q, n in pool.items()])).collect()}
    want = {}
    for q, n in pool.items():
        near = [(-m, p) for p, m in pool.items() if len(p) == len(q) and m >= 2 * n and sum(a != b for a, b in zip(p, q)) == 1]
        if near:
            want[q] = min(near)[1]
    assert got == want


def test_chimeras_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for s in ("s1", "s2"):
        pool = {"".join(rng.choice("ACGT") for _ in range(rng.choice([9, 10]))): rng.randint(10, 40) for _ in range(8)}
        names = sorted(pool)
        for _ in range(30):
            a, b = rng.sample(names, 2)
            cut = rng.randint(1, 8)
            pool.setdefault(a[:cut] + b[cut:], rng.randint(1, 25))
        rows += [(s, q, n) for q, n in pool.items()]

    def common(a, b):
        return sum(1 for _ in itertools.takewhile(lambda t: t[0] == t[1], zip(a, b)))

    def chimeric(s, q, n):
        parents = [p for t, p, m in rows if t == s and p != q and m >= 2 * n]
        left = {p: min(common(q, p), len(q) - 1) for p in parents}
        right = {p: min(common(q[::-1], p[::-1]), len(q) - 1) for p in parents}
        return any(left[a] and right[b] and left[a] + right[b] >= len(q) for a in parents for b in parents if a != b)

    got = {(r["sample_id"], r["seq"]): r["chimeric"] for r in A.chimera_flags(uniques(spark, rows)).collect()}
    want = {(s, q): chimeric(s, q, n) for s, q, n in rows}
    assert got == want and 10 < sum(want.values()) < len(want)


def test_error_rates_count_substitutions(spark):
    rows = [("s", f"r{i}", 1, "ACGTA", [30] * 5) for i in range(10)] + [("s", "e", 1, "ACGTT", [30, 30, 30, 30, 7])]
    df = spark.createDataFrame(rows, "sample_id string, read_id string, mate int, seq string, qual array<int>")
    df = df.union(spark.createDataFrame([("s", "e", 2, "TTTTT", [9] * 5)], df.schema))
    rates = A.error_rates(df).collect()
    assert {(r["ref"], r["obs"], r["q"], r["n"]) for r in rates if r["mate"] == 2} == {("T", "T", 9, 5)}
    got = {(r["ref"], r["obs"], r["q"]): r["n"] for r in rates if r["mate"] == 1}
    assert got[("A", "T", 7)] == 1 and got[("A", "A", 30)] == 21 and ("T", "T", 7) not in got


def test_classifier_recovers_planted_lineage(spark):
    rng = random.Random(4)
    genomes = {g: "".join(rng.choice("ACGT") for _ in range(900)) for g in ("a1", "a2", "b1")}
    ref = spark.createDataFrame([(g[0], g, t) for g, t in genomes.items()], "domain string, genus string, seq string")
    asked = [(f"{g}.{i}", t[i * 200 : i * 200 + 250]) for g, t in genomes.items() for i in range(3)]
    noise = "".join(rng.choice("ACGT") for _ in range(250))
    out = A.classify(spark.createDataFrame([*asked, ("noise", noise)], "id string, seq string"), ref, ["domain", "genus"])
    got = {r["id"]: r for r in out.collect()}
    for g, _ in asked:
        assert got[g]["genus"] == g.split(".")[0] and got[g]["genus_confidence"] > 0.9
    assert got["noise"]["genus_confidence"] < 0.6
    odd = spark.createDataFrame([("short", "ACG"), ("far", "N" * 60), ("same", genomes["a1"])], "id string, seq string")
    got = {r["id"]: r for r in A.classify(odd, ref, ["domain", "genus"]).collect()}
    for name in ("short", "far"):
        assert (got[name]["domain"], got[name]["genus"], got[name]["genus_confidence"]) == ("unclassified_root", "unclassified_root", 0.0)
    assert got["same"]["genus"] == "a1" and got["same"]["genus_confidence"] == 1.0


def test_chimera_parents_must_be_more_abundant(spark):
    with pytest.raises(ValueError):
        A.chimera_flags(uniques(spark, [("s", "ACGT", 3)]), fold=1.0)


def test_long_text_kmers_are_complete(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("ACGT\n é") for _ in range(1500))
    got = {r["kmer"] for r in A.explode_kmers(spark.createDataFrame([(text,)], "seq string"), "seq", 8).collect()}
    assert got == {text[i : i + 8] for i in range(len(text) - 7)}
