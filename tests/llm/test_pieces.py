"""Encoding and decoding, held against the library itself."""

import hashlib
import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from quern.llm import pieces, queries
from quern.llm.common import table

RNG = random.Random(3)
PARTS = ["a", "b", "e", "t", "h", " ", "  ", "▁", "\n", "é", "漢", "😀", "\x00", "0", "th", "the ", " and", "ing", "er", "in", "A", "<0x0A>", "<s>", "\t", "ß", "▁▁▁"]
TEXTS = [None, "", " ", "   ", " " * 40, "a", "▁", "x" * 5000, "ab" * 3000, "aaab" * 2000, "e" * 33 + " " * 9 + "\n" * 7]
TEXTS += ["".join(RNG.choice(PARTS) for _ in range(RNG.randint(1, 80))) for _ in range(1500)]
TEXTS += ["".join(chr(RNG.choice([RNG.randint(32, 126), RNG.randint(160, 0x500), RNG.randint(0x4E00, 0x5000), RNG.randint(0x1F300, 0x1F600)])) for _ in range(100)) for _ in range(100)]
TEXTS += ["".join(RNG.choice("etaoinshrdlu") for _ in range(300)) for _ in range(100)]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=pieces.default_model())


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_ids_and_texts_are_the_librarys(spark, library):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(3)
    found = {r["doc_id"]: numbers(r["ids"]) for r in pieces.encode(rows).collect()}
    want = {i: library.encode(t or "", add_bos=True, add_eos=True) for i, t in enumerate(TEXTS)}
    assert found == want
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(rows)).collect()}
    assert back == {i: library.decode(ids) for i, ids in want.items()}


def test_any_ids_decode_as_in_the_library(library):
    found = pieces.vocabulary(pieces.default_model())
    some = [0, 1, 2, 3, 4, 10, 0xC3 + 3, 0xA9 + 3, 0xE6 + 3, 0xBC + 3, 0xA2 + 3, 0xF0 + 3, 259, 264, 28705, 1233]
    for _ in range(3000):
        ids = [RNG.choice([*some, RNG.randrange(32000)]) for _ in range(RNG.randint(0, 12))]
        assert found.text(np.array(ids, np.int64)).decode() == library.decode(ids), ids
    with pytest.raises(ValueError):
        found.text(np.array([32000]))


def test_long_texts_are_encoded_in_stretches(monkeypatch, library):
    monkeypatch.setattr(pieces, "SLICE_CHARS", 50)
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    found, text = pieces.Encoder(pieces.vocabulary(pieces.default_model())), " ".join(TEXTS[20:60]) + "é" * 300
    parts = list(pieces.stretches(text))
    assert len(parts) > 10
    ids = [1, *(i for p in parts for i in found.encode([p])[0].tolist()), 2]
    assert ids == library.encode(text, add_bos=True, add_eos=True)
    assert found.of.text(np.array(ids)).decode() == library.decode(ids)


def test_no_rows_and_repeats(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, numbers(r["ids"])) for r in pieces.encode(rows).collect()) == [(0, [1, 2]), (1, [1, 264, 287, 2]), (1, [1, 264, 287, 2])]
    assert pieces.decode(pieces.encode(rows.limit(0))).collect() == []
    nulls = spark.createDataFrame([(1, None)], "n int, ids binary")
    assert [tuple(r) for r in pieces.decode(nulls).collect()] == [(1, None)]


def test_query_over_a_whole_table(spark, library):
    data = "/root/testdata/sf0.001"
    want = {}
    for r in table(spark, data, "documents").collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_pieces(spark, data).collect()} == want
