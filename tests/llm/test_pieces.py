"""SentencePiece ids and texts against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from brute import ODD
from pyspark.errors import PythonException
from sentencepiece import SentencePieceProcessor

from tallyweave.llm import pieces, queries
from tallyweave.llm.pieces import PieceModel

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  ", "   a", "a   ", " " * 200, "x" + " " * 37 + "y", "▁a", " ▁▁ b", "\n\n\t a", "a" * 1000, "ab" * 500, "aba" * 300, "​​", "漢字かな" * 20,
    "\U0001f600é́ﬁ" * 9, "<s></s><unk><0x0A>", "\0", "﻿x", "　x\xa0y\r\n", "𐍈" * 3, "the quick", "\x7f\x80߿ࠀ￿\U00010000",
]


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def some_texts():
    rng = random.Random(3)
    letters, parts = list("abcdefe  \n▁tinhe'0<é"), ["a", "aa", "ab", "ba", "  ", "    ", "in", "ing", " t", "the", " "]
    mixed = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    return mixed + ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(6000)]


def test_ids_and_texts_are_the_library_s(model, library, small):
    texts = TEXTS + some_texts() + [t for _, t in small]
    got, want = model.encode(texts), library.encode(texts, add_bos=True, add_eos=True)
    assert [g.tolist() for g in got] == want
    assert [model.decode(g) for g in got] == library.decode(want)
    assert [model.encode([t])[0].tolist() for t in TEXTS] == library.encode(TEXTS, add_bos=True, add_eos=True)


def test_pieces_in_random_order(model, library):
    rng = random.Random(8)
    words = [library.id_to_piece(i) for i in range(259, 32000)]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(5000)]
    assert [g.tolist() for g in model.encode(texts)] == library.encode(texts, add_bos=True, add_eos=True)


def test_ids_that_no_text_gives(model, library):
    rng = random.Random(2)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(32000), 0, 1, 2, 28705, 259]) for _ in range(rng.randrange(8))]
        assert model.decode(np.array(ids, "<u4")) == library.decode(ids), ids
    with pytest.raises(ValueError):
        model.decode(np.array([32000], "<u4"))


def test_long_texts_are_taken_in_parts(monkeypatch, model, library, small):
    monkeypatch.setattr(pieces, "SLICE", 50)
    long = " ".join(t for _, t in small[:20]) + "   " + "x" * 300 + "  " + " " * 400 + "end"
    assert len(list(pieces._parts("▁" + long.replace(" ", "▁")))) > 10
    assert model.encode([long, "", long])[2].tolist() == library.encode(long, add_bos=True, add_eos=True)


def test_words_without_blanks(model, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(20000)), "".join(rng.choice("=/+aZ09") for _ in range(20000))]
    assert [g.tolist() for g in model.encode(texts)] == library.encode(texts, add_bos=True, add_eos=True)


def test_column_round_trip(spark, documents, library, small):
    docs = small + list(ODD) + [small[0], (None, None), (7, " " * 3)]
    df = documents(docs, clashing=True)
    out = pieces.decode(pieces.encode(df, PATH, ids="ids"), PATH)
    assert set(out.columns) == {*df.columns, "decoded"}
    got = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in out.collect()), key=repr)
    want = [(d, library.encode(t or "", add_bos=True, add_eos=True)) for d, t in docs]
    assert got == sorted(((d, ids, library.decode(ids)) for d, ids in want), key=repr)
    assert all(text == (t or "") for (_, _, text), (_, t) in zip(sorted(got, key=repr), sorted(docs, key=lambda x: repr((x[0], library.encode(x[1] or "", add_bos=True, add_eos=True))))))
    assert pieces.digests(documents([]), PATH).count() == 0


def test_bad_ids_raise(spark):
    df = spark.createDataFrame([(1, b"\xff\xff\x00\x00")], "doc_id bigint, ids binary")
    with pytest.raises(PythonException, match="outside the vocabulary"):
        pieces.decode(df, PATH).collect()
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids binary"), PATH).first()["decoded"] is None


def test_query(spark, library):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op11_sentencepiece"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids, r = library.encode(d["text"] or "", add_bos=True, add_eos=True), rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
