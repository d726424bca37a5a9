"""The pipeline's stages against brute force, and its registered query."""

import pytest
from brute import ODD, contamination, near_duplicates, without_lines

import __spark_entry__ as entry
import corpus_pipeline
from tallyweave.llm.common import stored

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    names = entry.queries()
    assert "pipeline" in names and all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 11))


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now, want = docs, sorted(small)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stored(stage(spark, now, SF), "test-stage")
        if name == "line dedup":
            want = without_lines(want)
        elif name == "SimHash near-dedup":
            want = [x for x, (d, _, c) in zip(want, near_duplicates(want, 5)) if d == c]
        elif name == "benchmark decontamination":
            want = [x for x, (_, _, hit, _) in zip(want, contamination(want, bench, 10)) if not hit]
        assert now.columns == COLUMNS and pairs(now) == sorted(want, key=repr), name
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == {d for d, _ in want}
    assert all(r["offset"] + r["length"] <= 4096 for r in rows)


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_tables_pass_every_stage(spark, documents, rows):
    now = documents(rows, clashing=True)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stored(stage(spark, now, SF), "test-odd")
        assert k == 4 or now.columns[:5] == COLUMNS and "n_hit" in now.columns
    assert (now.count() > 0) == bool(rows)
