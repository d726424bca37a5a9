"""Benchmark decontamination."""

import pytest
from brute import ODD, contamination, words_of

from tallyweave.llm import decontaminate as op

ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, "..."), (4, None), (None, "no id here"),
    (5, "quick brown"), (6, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "short item"), (7, "ÉTÉ"),
]
TEXTS = [
    (20, "x alpha BETA gamma-delta epsilon, zeta eta theta iota kappa lambda mu nu"),
    (21, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (22, "a short item and a short  item; shortitem"),
    (23, "ÉTÉ été étÉ"),
    (24, "short item short"),
]


def rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in df.collect()), key=repr)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("n", [10, 3])
def test_against_brute_force(documents, items, limit, n):
    docs = ODD + TEXTS + [TEXTS[0]]
    found = op.contamination(documents(docs, clashing=True), items(ITEMS), n, limit)
    assert rows(found) == sorted(contamination(docs, ITEMS, n), key=repr)


def test_whole_table(spark, documents, small):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = contamination(small, [(r["item_id"], r["text"]) for r in bench.collect()], 10)
    assert rows(op.contamination(documents(small), bench)) == sorted(want, key=repr)
    kept = {r["doc_id"] for r in op.remove_documents(documents(small), bench).collect()}
    assert kept == {d for d, _, hit, _ in want if not hit}


def test_empty_tables(documents, items):
    assert op.contamination(documents([]), items(ITEMS)).count() == 0
    assert all(r["n_hit"] == 0 for r in op.contamination(documents(TEXTS), items([])).collect())
    assert op.remove_documents(documents(ODD, clashing=True), items([])).count() == len(ODD)


def test_spans_go_and_the_rest_stays(documents, items):
    cut = op.remove_spans(documents(TEXTS + ODD, clashing=True), items(ITEMS))
    by = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert by[20] == "x nu" and by[22] == "a and a shortitem" and by[21] == TEXTS[1][1] and by[1] is None
    assert words_of(by[24]) == ["short"] and "n_hit" in cut.columns
