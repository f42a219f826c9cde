"""SentencePiece ids against the library, and the way back."""

import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarte.llm import pieces

SCHEMA = "doc_id long, text string, ids string"
ODD = ["", "   ", " a ", "▁", "x" * 3000, " " * 40 + "a", "a\x00b", "日本語のテキスト。", "😀é" * 30, "İstanbul ΟΔΥΣΣΕΥΣ", "<s> <unk> <0x41>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.tokenizer_path(pieces.MODEL))


def same(texts, library):
    ids, n = pieces.encoder(pieces.MODEL).encode([t.encode() for t in texts])
    got = np.split(ids.astype(np.int64), np.cumsum(n)[:-1]) if texts else []
    assert [g.tolist() for g in got] == library.encode(texts)
    for t, g in zip(texts, got):
        assert pieces.decode(g, pieces.encoder(pieces.MODEL).model).decode() == t.replace("▁", " ")


def test_odd_texts(library):
    same(ODD, library)


def test_texts_of_pieces(library):
    r, model = random.Random(3), pieces.encoder(pieces.MODEL).model
    every = [model.pieces[i].replace("▁", " ") for i in model.usable]
    same(["".join(r.choice(every) for _ in range(40)) for _ in range(600)], library)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab cdeA1ä▁😀 \n"), max_size=40), max_size=5))
def test_equals_library(texts):
    same(texts, sentencepiece.SentencePieceProcessor(model_file=pieces.tokenizer_path(pieces.MODEL)))


def test_suffix_array_orders_by_bytes():
    data = np.frombuffer(b"banana\xffbandana\xffbananabananabanana\xff", np.uint8)
    order, _ = pieces.suffix_array(data, 48)
    raw = data.tobytes() + b"\0" * 64
    assert [raw[i : i + 48] for i in order] == sorted(raw[i : i + 48] for i in range(len(data)))


def test_documents(spark, library):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "plain text here", "plain text here"])] + [(None, "no id")]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in pieces.digests(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids, text = library.encode(t or ""), (t or "").replace("▁", " ").encode()
        r = got[i]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (r.decoded_bytes, r.decoded_crc32) == (len(text), zlib.crc32(text))
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(df)).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in rows}
    assert pieces.digests(spark.createDataFrame([], SCHEMA)).count() == 0
