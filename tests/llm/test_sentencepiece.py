import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlens.llm import sentencepiece_codec as C

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ALPHABET = list("abcdeth   \n\t▁.é世界😀<s> \xa0\u3000\x00\ufeff \r")


def ids(text):
    return np.frombuffer(C.codec(MODEL).encode(text), "<u4").tolist()


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(st.sampled_from(ALPHABET), max_size=60)))
def test_same_as_library(text):
    got = ids(text)
    assert got == LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert C.codec(MODEL).decode(got) == LIBRARY.decode(got)


def test_decodes_any_ids():
    random.seed(3)
    for _ in range(2000):
        some = [random.choice([random.randint(0, 31999), random.randint(0, 258)]) for _ in range(random.randint(0, 12))]
        assert C.codec(MODEL).decode(some) == LIBRARY.decode(some)


@pytest.mark.parametrize("text", ["x" * 50_000, " " * 300, "ab " * 20_000, "\n" * 50])
def test_long_texts(text):
    assert ids(text) == LIBRARY.encode(text, add_bos=True, add_eos=True)


def test_small_caches_give_the_same(monkeypatch):
    monkeypatch.setattr(C, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(C, "CACHE_PAIRS", 3)
    codec = C.PieceCodec(MODEL)
    text = "The quick brown fox jumps over the lazy dog, again and again."
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)


def test_round_trip(spark):
    rows = [(1, "A text.\nAnd more", "x"), (1, "A text.\nAnd more", "x"), (None, None, None), (2, "", "y")]
    got = C.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), MODEL).collect()
    assert len(got) == 4
    for r in got:
        text = "A text.\nAnd more" if r.doc_id == 1 else ""
        want = LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encode_then_decode(spark):
    frame = spark.createDataFrame([(1, "Ein Text"), (2, None)], "id int, text string")
    assert {r.id: r.decoded for r in C.decode(C.encode(frame, MODEL), MODEL).collect()} == {1: "Ein Text", 2: ""}


def test_empty_table(spark):
    assert C.round_trip(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
