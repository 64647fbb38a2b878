"""SentencePiece rounds beside the library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediaspark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH)


PARTS = [*"abeinrst", " ", "  ", " " * 17, "▁", "\n", "\0", "É", "é", "漢字", "=-=-", "____", "the", "ation", "<s>", "<0x0A>", "½", "xxxxxxx"]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), min_size=1, max_size=5))
def test_encode_and_decode_like_the_library(model, texts):
    ids, first = pieces.WordIds(model).encode(texts)
    own = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert own == LIBRARY.encode(texts)
    data, places = model.decode(ids, first)
    assert [data[a:b].decode() for a, b in zip(places[:-1], places[1:], strict=True)] == [LIBRARY.decode(x) for x in own]


@settings(max_examples=300, deadline=None)
@given(ids=st.lists(st.sampled_from([0, 1, 2, 13, 259, 260, 300, 0xE6 + 3, 0xBC + 3, 0xA2 + 3, 29871, 1000, 24000]), max_size=8))
def test_decode_any_ids(model, ids):
    data, _ = model.decode(np.array(ids, np.int64), np.array([0, len(ids)]))
    assert data.decode() == LIBRARY.decode(ids)


def test_long_words(model):
    for text in ("x" * 30_000, " " * 3000, "ab" * 5000, "=-" * 2000, "the" * 2000, "abcdefghij" * 500):
        ids, _ = pieces.WordIds(model).encode([text])
        assert ids.tolist() == LIBRARY.encode(text)


def test_table_is_bounded(model):
    encoder = pieces.WordIds(model, most=50)
    for k in range(20):
        encoder.encode([" ".join(f"word{k}x{i}" for i in range(30))])
        assert encoder.chars < 50 + 30 * 20


def test_round_trip_rows(docs, nothing):
    got = sorted((r.asDict() for r in pieces.round_trip(docs, PATH).collect()), key=str)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = LIBRARY.encode(r.text or "", add_bos=True, add_eos=True)
        want.append(
            {
                "doc_id": r.doc_id,
                "n_tokens": len(ids),
                "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                "decoded_sha256": hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(),
            }
        )
    assert got == sorted(want, key=str)
    assert pieces.round_trip(nothing, PATH).count() == 0


def test_encode_then_decode_columns(docs):
    odd = docs.select("*", F.lit("mine").alias("ids"), F.lit(1).alias("back`tick"))
    out = pieces.decode(pieces.encode(odd, PATH), PATH, "ids_").collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.ids == "mine" and r["back`tick"] == 1
        assert r.ids_ == LIBRARY.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.decoded == (r.text or "")


def test_decode_null_lists(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [1, None, 300])], "id int, ids array<int>")
    assert {r.id: r.decoded for r in pieces.decode(rows, PATH).collect()} == {1: None, 2: "", 3: LIBRARY.decode([1, 300])}
