"""Chat formatting with offset-aligned loss masks.

1. Rows are dealt by ranges of (conversation, turn), so that a conversation with a third of all rows is no single task. A task
   walks its rows in order and renders each conversation; one that passes PART_CHARS, or goes on in the next range, comes in
   several parts of whole turns.
2. A turn opens and closes with control strings. Control strings inside texts and roles get a backslash behind their first
   sign (one more, where they have some), which unescaping takes away again: no text can look like a turn.
3. A rendered part is encoded once, with offsets. Control strings are special tokens of the encoder, so that no token crosses
   the bounds of a text, and parts encode as the whole does. A token's turn is found by binary search of its start in the
   sorted ends of the turns' spans; the mask holds the tokens inside texts of the trained role.
4. read_back() takes turns from the rendered text and the trained text from the ids under the mask, decoded run by run.

Null texts and roles count as empty in the digests; a null role is told from an empty one in the rendered text. Rows of equal
turn are ordered by role and text, null turns come first, rows without a conversation id are one conversation. Empty texts make empty spans. Texts
may be of any length. Other columns are not carried over. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paperlens.llm.common import bounded, held

#: Opening and closing control strings by role. Any other role is written out.
TURNS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
NAMED, TEXT, NAMELESS, CLOSED = "[ROLE]", "[TEXT]", "[NOROLE]", "[/ROLE]"
CONTROLS = [*(c for pair in TURNS.values() for c in pair), NAMED, TEXT, NAMELESS, CLOSED]
#: Code points from which a conversation goes on in a further part, and code points encoded at once.
PART_CHARS, BATCH_CHARS = 1_000_000, 2_000_000


class Template:
    """Renders turns and reads them back. reserved: further strings that mean something to the encoder."""

    def __init__(self, reserved: list[str]):
        strings = [*CONTROLS, *(s for s in reserved if s not in CONTROLS)]
        rest = "|".join(f"{re.escape(s[0])}\\\\*(?={re.escape(s[1:])})" for s in strings)
        self._escape = re.compile(f"(?:{rest})")
        self._controls = re.compile("|".join(map(re.escape, CONTROLS)))
        self._role = {opening: role for role, (opening, _) in TURNS.items()}

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._escape.sub(lambda m: m[0][0] + m[0][2:], text)

    def render(self, turns: list[tuple[str | None, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the span of each turn's (escaped) text in it."""
        out, spans, at = [], [], 0
        for role, text in turns:
            opening, closing = TURNS.get(role) or ((NAMELESS if role is None else f"{NAMED}{self.escape(role)}{TEXT}"), CLOSED)
            inside = self.escape(text)
            spans.append((at + len(opening), at + len(opening) + len(inside)))
            out += [opening, inside, closing]
            at = spans[-1][1] + len(closing)
        return "".join(out), spans

    def turns(self, rendered: str) -> Iterator[tuple[str | None, str]]:
        """What was rendered: role and text of each turn."""
        role, at = None, 0
        for m in self._controls.finditer(rendered):
            inside, sign = rendered[at : m.start()], m[0]
            if sign == TEXT:
                role = self.unescape(inside)
            elif sign in self._role:
                role = self._role[sign]
            elif sign == NAMELESS:
                role = None
            elif sign != NAMED:
                yield role, self.unescape(inside)
            at = m.end()


class Encoder:
    """A tokenizer file with the control strings as special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        own = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        self.template = Template(own)

    def encode(self, texts: list[str]):
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def decode(self, runs: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(runs, skip_special_tokens=False) if runs else []


def encoder(path: str) -> Encoder:
    return held(f"chat {path}", lambda: Encoder(path))


def loss_mask(offsets: np.ndarray, spans: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """1 for tokens (offsets, sorted) inside a span (sorted) that is trained on. A token across the bounds of a text is an error."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), "int8")
    turn = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    at = np.minimum(turn, len(spans) - 1)
    inside = (turn < len(spans)) & (spans[at, 0] < offsets[:, 1])
    if (inside & ((offsets[:, 0] < spans[at, 0]) | (offsets[:, 1] > spans[at, 1]))).any():
        raise ValueError("a token crosses the bounds of a text")
    return (inside & trained[at]).astype("int8")


def _runs(ids: np.ndarray, mask: np.ndarray) -> list[list[int]]:
    """Ids of each unbroken run of the mask."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    return [ids[a:b].tolist() for a, b in zip(edges[::2], edges[1::2], strict=True)]


FORMATTED = [T.StructField("part", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("formatted", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss", T.ArrayType(T.ByteType()))]


def formatted(df: DataFrame, tokenizer: str, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """key, part (ascending within a conversation), whole (no other part exists), formatted, ids, loss (1: trained on)."""
    rows = df.select(F.col(key).alias("id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = ["id", "turn", "role"]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    kind = to_arrow_type(df.schema[key].dataType)

    def pieces(batches) -> Iterator[tuple]:
        """id, turns, whether rows of the same conversation can be elsewhere."""
        at, turns, size, begun, first = None, [], 0, False, True
        for batch in batches:
            for k, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if turns and k != at:
                    yield at, turns, begun or first
                    turns, size, begun, first = [], 0, False, False
                elif size > PART_CHARS:
                    yield at, turns, True
                    turns, size, begun = [], 0, True
                at = k
                turns.append((r, t))
                size += len(t)
        if turns:
            yield at, turns, True

    def work(batches):
        coder, number, waiting, size = encoder(tokenizer), TaskContext.get().partitionId() << 32, [], 0

        def out():
            nonlocal number
            rendered = [coder.template.render(turns) for _, turns, _ in waiting]
            ids, masks = [], []
            for e, (_, spans), (_, turns, _) in zip(coder.encode([r for r, _ in rendered]), rendered, waiting, strict=True):
                ids.append(pa.array(e.ids, pa.int32()))
                masks.append(pa.array(loss_mask(np.array(e.offsets, "int64").reshape(-1, 2), np.array(spans, "int64"), np.array([r == trained for r, _ in turns]))))
            numbers = range(number, number + len(waiting))
            number += len(waiting)

            def lists(parts, type_):
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32()), pa.concat_arrays([p.cast(type_) for p in parts]))

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in waiting], kind), pa.array(numbers, pa.int64()), pa.array([not more for _, _, more in waiting]), pa.array([r for r, _ in rendered]),
                    lists(ids, pa.int32()), lists(masks, pa.int8()),
                ],
                [key, "part", "whole", "formatted", "ids", "loss"],
            )
            waiting.clear()

        for piece in pieces(batches):
            waiting.append(piece)
            size += sum(len(t) for _, t in piece[1])
            if size > BATCH_CHARS or len(waiting) >= 1_000:
                yield from out()
                size = 0
        if waiting:
            yield from out()

    return bounded(dealt).mapInArrow(work, T.StructType([df.schema[key], *FORMATTED]))


class _Digest:
    def __init__(self):
        self.turns, self.loss, self.n_turns, self.loss_chars, self.formatted_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, coder: Encoder, rendered: str, ids: np.ndarray, mask: np.ndarray) -> _Digest:
        for role, text in coder.template.turns(rendered):
            self.turns.update(f"{role or ''}\n{text}\n".encode())
            self.n_turns += 1
        for text in map(coder.template.unescape, coder.decode(_runs(ids, mask))):
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars += len(rendered)
        return self

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


READ = [T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]


def read_back(parts: DataFrame, tokenizer: str) -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from the columns of formatted().
    Conversations in one part are read where they are; only the parts of others meet, one after another."""
    key = parts.columns[0]
    names = [f.name for f in READ]
    between = T.StructType([parts.schema[key], *(f for f in FORMATTED if f.name != "whole"), *READ])

    def values(batch, name):
        return batch.column(batch.schema.get_field_index(name))

    def numbers(column):
        return column.values.to_numpy(), column.offsets.to_numpy()

    def alone(batches):
        for batch in batches:
            coder, whole, out = encoder(tokenizer), values(batch, "whole").to_pylist(), []
            (ids, at), (loss, _) = numbers(values(batch, "ids")), numbers(values(batch, "loss"))
            for i, text in enumerate(values(batch, "formatted").to_pylist()):
                out.append(_Digest().add(coder, text, ids[at[i] : at[i + 1]], loss[at[i] : at[i + 1]]).row() if whole[i] else (None,) * len(READ))
            split = pa.array([not w for w in whole])
            carried = [pc.if_else(split, c, pa.scalar(None, c.type)) for c in (values(batch, n) for n in ("formatted", "ids", "loss"))]
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), values(batch, "part"), *carried, *columns], between.names)

    def together(batches):
        at, digest, begun = None, None, False

        def row(k, x):
            return pa.RecordBatch.from_pylist([{key: k, **dict(zip(names, x, strict=True))}], schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0), *(batch.schema.field(n) for n in names)])
            done = values(batch, "n_turns").is_valid()
            ready = batch.select([key, *names]).filter(done)
            if ready.num_rows:
                yield ready
            rest = batch.filter(pc.invert(done))
            for r in range(rest.num_rows):
                k, coder = rest.column(0)[r].as_py(), encoder(tokenizer)
                if begun and k != at:
                    yield row(at, digest.row())
                if not begun or k != at:
                    at, digest, begun = k, _Digest(), True
                digest.add(coder, values(rest, "formatted")[r].as_py(), values(rest, "ids")[r].values.to_numpy(), values(rest, "loss")[r].values.to_numpy())
        if begun:
            yield row(at, digest.row())

    first = bounded(parts).mapInArrow(alone, between)
    dealt = first.repartition(key).sortWithinPartitions(key, "part")
    return dealt.mapInArrow(together, T.StructType([parts.schema[key], *READ]))
