import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperlens.llm import token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ALPHABET = list("abcdeth   \n\t.é世界😀 \xa0\u3000\x00\ufeff\r1２½²'!\x1c\x85ªſ")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*ALPHABET, "'s", "'re", "<|endoftext|>", " '"]), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_split_and_count(parts):
    text, s = "".join(parts), C.splitter(PATH)
    found = s.split(text)
    assert "".join(found) == text
    assert (int(s.count(found).sum()) if found else 0) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_counts(spark, monkeypatch):
    random.seed(1)
    texts = [" ".join(random.choice(["the", "of", "Wort", "été", "x" * 30, "1,234"]) for _ in range(random.randint(0, 200))) for _ in range(300)]
    rows = [*enumerate(texts), (7, None), (7, ""), (None, "a b"), (9, "a " * 70_000), (9, "<|endoftext|>")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_bytes int")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(frame, PATH, limit=100).collect())
    want = sorted((-1 if i is None else i or -1, len((t or "").encode()), n := len(LIBRARY.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in rows)
    assert got == want


def test_empty_table(spark):
    assert C.token_counts(spark.createDataFrame([], "doc_id string, text string"), PATH).count() == 0
