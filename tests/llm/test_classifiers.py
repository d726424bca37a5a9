"""Language identification and toxicity."""

import zlib

import numpy as np
import pytest
from brute import ODD
from pyspark.sql import functions as F

from tallyweave.llm import langid, toxicity


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def languages(table):
    return langid.train(table.filter("pmod(crc32(cast(doc_id as string)), 3) <> 1"), sample=100)


def test_held_out_languages(table, languages):
    held = table.filter("pmod(crc32(cast(doc_id as string)), 3) = 1")
    rows = langid.predict(held, languages).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert set(languages["machines"]) == {"family:germanic", "family:romance", "de|en", "es|fr"}


def test_odd_texts(documents, languages):
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(documents(ODD, clashing=True), languages).collect()}
    assert all(rows[d] == ("und", 0.0) for d in (1, 2, 3, 7)) and all(rows[d][0] != "und" for d in (4, 6, 8, 9, 11))
    kept = langid.keep_identified(documents(ODD, clashing=True), languages)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in ODD} - {1, 2, 3, 7} and "n_hit" in kept.columns
    assert langid.predict(documents([]), languages).count() == 0


def test_few_languages(spark, documents):
    learn = lambda rows: langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    none = learn([(1, "a text", None), (2, "---", "en"), (3, "b", "und")])
    assert {r["lang_pred"] for r in langid.predict(documents(ODD), none).collect()} == {"und"}
    one = learn([(1, "a text", "xx")])
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(documents([(1, "word")]), one).collect()} == {("xx", 1.0)}
    alone = learn([(i, t, lang) for i, (t, lang) in enumerate([("aba bab aab", "l1"), ("xyx yxy xxy", "l2"), ("mnm nmn mmn", "l3")] * 5)])
    rows = {r["doc_id"]: r["lang_pred"] for r in langid.predict(documents([(1, "ab aba"), (2, "xy yxy"), (3, "mn nmn")]), alone).collect()}
    assert rows == {1: "l1", 2: "l2", 3: "l3"}


def test_families():
    assert langid.family_of("de") == langid.family_of("en-US") != langid.family_of("fr") and langid.family_of("zz") == "zz"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")


@pytest.fixture(scope="module")
def scorer(spark, table, labels):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return toxicity.train(table, labels.filter(~held))


def test_held_out_toxicity(table, labels, scorer):
    rows = toxicity.score(table, scorer).join(labels, "doc_id").collect()
    held = [(r["score"], r["toxic"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in held if y for b, z in held if not z]
    assert np.mean(pairs) > 0.8 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize(
    ("spelling", "word"),
    [("1d10t", "idiot"), ("s t u p i d", "stupid"), ("st.up.id", None), ("stuuuupid", "stupid"), ("tr@sh", "trash"), ("m-o-r-o-n", "moron"), ("w0rthl3ss", "worthless"), ("c.l.o.w.n", "clown"), ("p@th3t1c", "pathetic"), ("t r @ s h", "trash"), ("l0s3r", "loser")],
)
def test_disguises_are_decoded(scorer, spelling, word):
    import pyarrow as pa

    reader = toxicity.Reader(toxicity.CharacterModel(scorer["chars"]))
    (words,) = reader.words(pa.array([f"Of the {spelling} and to"]))
    assert word is None or word in words


def test_disguised_texts_score_like_plain_ones(documents, scorer):
    base = "Of the onre was that {} and the tionst with thnd {} ering."
    rows = [(1, base.format("idiot", "trash")), (2, base.format("1d10t", "t r a s h")), (3, base.format("thea", "onst")), (4, None), (5, ""), (6, base.format("idiooot", "tr@sh"))]
    by = {r["doc_id"]: r["score"] for r in toxicity.score(documents(rows + [(d, t) for d, t in ODD if d and d > 6], clashing=True), scorer).collect()}
    assert min(by[1], by[2], by[6]) > 0.5 > max(by[3], by[4], by[5])
    assert toxicity.score(documents([]), scorer).count() == 0


def test_without_both_classes(spark, documents):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id bigint, toxic int")
    for rows in [], [(4, 1)], [(4, 0), (None, 1), (5, None)]:
        model = toxicity.train(documents(ODD), labels(rows))
        assert all(0 <= r["score"] <= 0.5 for r in toxicity.score(documents(ODD), model).collect())


def test_character_counts_grow_with_the_texts(documents):
    one, two = toxicity.character_counts(documents([(1, "abc")])), toxicity.character_counts(documents([(1, "abc"), (2, "abc abc"), (3, None)]))
    assert two.sum() > one.sum() > 0 and toxicity.character_counts(documents([])).sum() == 0


def test_counting_letters_takes_little_memory(monkeypatch):
    import tracemalloc


    texts = [b"Some words, and more of them.  " * 80 for _ in range(10000)] + [b"one long text " * 200_000]
    tracemalloc.start()
    counted = toxicity.CharacterModel.counts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and counted.sum() > 20_000_000
    # windows inside a text don't show
    monkeypatch.setattr(toxicity, "_SLICE", 7)
    long = [b"ab  cd, -- efg" * 30]
    small = toxicity.CharacterModel._counted(long)
    monkeypatch.setattr(toxicity, "_SLICE", 1 << 20)
    assert (small == toxicity.CharacterModel._counted(long)).all() and isinstance(small, np.ndarray)
