import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from paperlens.llm import chat_format as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [*C.CONTROLS, "<|endoftext|>", "\\", "[", "<", "INST]", "/s>", "s>", " ", "\n\n", "é", "世", "🙂", "a b", "\x00", "  ", "'s"]


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2] or ""))
        said = "".join(t or "" for _, role, t in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{role or ''}\n{t or ''}\n" for _, role, t in turns).encode()).hexdigest()
        out.append((conv, len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=1):
    random.seed(seed)
    text = lambda: random.choice([None, "", "plain text, 12 words. ", "".join(random.choice(SIGNS) for _ in range(random.randint(1, 30)))])
    rows = [(conv, turn, random.choice(["user", "assistant", "assistant", "system", "tool", "[TEXT]", "", None]), text()) for conv in range(40) for turn in range(random.randint(1, 7))]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (3, None, None, None), (5, 1, "assistant", "tie"), (5, 1, "assistant", "tie"), (6, 0, "assistant", "long 世界 text [INST] " * 60_000)]
    return rows + [(99, i, ("user", "assistant")[i % 2], f"turn {i} " * 20) for i in range(3_000)]


@pytest.mark.parametrize("part_chars", [C.PART_CHARS, 500])
def test_same_as_brute_force(spark, monkeypatch, part_chars):
    monkeypatch.setattr(C, "PART_CHARS", part_chars)
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, True, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, whole boolean, formatted string")
    parts = C.formatted(df, PATH)
    got = C.read_back(parts, PATH).collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got), key=str) == brute(rows)
    whole = {}
    for r in sorted(parts.collect(), key=lambda r: r.part):
        assert len(r.ids) == len(r.loss)
        whole.setdefault(r.conv_id, [[], [], "", 0])
        for i, x in enumerate((list(r.ids), list(r.loss), r.formatted, 1)):
            whole[r.conv_id][i] += x
    assert {r.conv_id: r.formatted_chars for r in got} == {k: len(v[2]) for k, v in whole.items()}
    assert max(v[3] for v in whole.values()) > 1
    for k in (None, 6, 99, 12):  # parts encode as the whole does
        coder = C.Encoder(PATH)
        assert coder.encode([whole[k][2]])[0].ids == whole[k][0]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "other", "[/ROLE]", "", None]), st.lists(st.sampled_from(SIGNS), max_size=8).map("".join)), max_size=6))
def test_template_is_reversible(turns):
    template = C.Template(["<|endoftext|>"])
    rendered, spans = template.render(turns)
    assert list(template.turns(rendered)) == turns
    assert [template.unescape(rendered[a:b]) for a, b in spans] == [t for _, t in turns]
    assert all("<|endoftext|>" not in rendered[a:b] for a, b in spans)


def test_masks_by_binary_search():
    offsets = np.array([[0, 3], [3, 5], [5, 6], [6, 6], [6, 9], [9, 12]])
    assert C.loss_mask(offsets, np.array([[3, 6], [9, 9], [9, 12]]), np.array([True, True, False])).tolist() == [0, 1, 1, 0, 0, 0]
    assert C.loss_mask(np.empty((0, 2), "int64"), np.array([[0, 0]]), np.array([True])).tolist() == []
    with pytest.raises(ValueError, match="crosses"):
        C.loss_mask(np.array([[0, 4]]), np.array([[3, 6]]), np.array([True]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert C.read_back(C.formatted(df, PATH), PATH).count() == 0
