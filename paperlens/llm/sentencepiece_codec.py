"""SentencePiece BPE encoding and decoding.

Encoding follows the backtracking method: an Aho-Corasick automaton over the pieces gives the longest piece that starts
at each character; pieces are taken greedily, and a piece may follow another only if re-merging the text of both gives
that very pair; where no shorter prefix fits, the last piece is taken back and the position is marked in a field of
failed positions, so that none is tried twice. A sequence whose neighbours are all compatible is the one that merging by
score yields.

No piece of such a vocabulary holds the space sign after another character, and some characters (line ends among them)
occur in no piece, so a text falls apart into chunks that never merge across their borders. Workers keep a cache of
chunk -> ids, bounded in entries and in the length of a chunk; cost per document is then mostly one dictionary lookup a word.
Texts of any length are encoded whole, also those without a space.

Null and empty text: begin and end ids only, decoded as the empty string. Repeated rows and repeated ids give one row
each. Columns of the input that clash with result columns are not carried over.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperlens.llm.common import bounded, held

SPACE = "▁"
#: Entries that a worker keeps before it starts its cache of chunks, or of pairs, anew; longer chunks are not cached.
CACHE_CHUNKS, CACHE_PAIRS, CACHE_CHARS = 300_000, 200_000, 48
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _one_sign_a_byte(error):
    return "�", error.start + 1


codecs.register_error("paperlens_byte", _one_sign_a_byte)


class _Chunks(dict):
    def __init__(self, codec: "PieceCodec"):
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        ids = self.codec.encode_chunk(chunk)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = out
        return out


class PieceCodec:
    """Encoder and decoder for one .model file of kind BPE with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.score = {}
        self.byte_id: dict[int, int] = {}
        self.unk = model.unk_id()
        self.control: set[int] = set()
        out: list[bytes] = []
        for i, piece in enumerate(self.text):
            if model.is_control(i):
                out.append(b"\xff")  # never valid: see decode()
                self.control.add(i)
            elif model.is_unknown(i):
                out.append(" ⁇ ".encode())
            elif model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                out.append(bytes([int(piece[3:5], 16)]))
            else:
                self.score[piece] = (model.get_score(i), i)
                out.append(piece.replace(SPACE, " ").encode())
        self.out = out
        self.bytes = set(self.byte_id.values())
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece holds the space sign after another character")
        self.alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.score))
        self.pattern = re.compile(f"{SPACE}+[^{SPACE}{self.alone}]*|[^{SPACE}{self.alone}]+" + (f"|[{self.alone}]" if self.alone else ""))
        self.length = [len(p) for p in self.text]
        self.foreign: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: list[int] = [-1] * size
        self.rank = [-1] * size
        self.halves: list[tuple[int, int]] = [(-1, -1)] * size
        # Pieces that merging cannot build never occur in a result. rank: order of merging, equal for equal scores; -1: a single character.
        merged = {p: self.merge(p) for p in self.score}
        whole = {p: i for p, (_, i) in self.score.items() if merged[p][0] == [i]}
        order = {x: k for k, x in enumerate(sorted({x for x, _ in self.score.values()}, reverse=True))}
        self.rank_of = {p: order[x] for p, (x, _) in self.score.items() if len(p) > 1}
        for p, i in whole.items():
            if len(p) > 1:
                self.rank[i] = order[self.score[p][0]]
                self.halves[i] = tuple(whole[x] if x in whole else self.single(x) for x in merged[p][1])
        self.whole = whole
        self.automaton = ahocorasick.Automaton()
        for p, i in whole.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        for p, i in whole.items():
            self.shorter[i] = next((whole[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in whole), -1)
            if self.shorter[i] < 0 and len(p) > 1:
                self.shorter[i] = self.single(p[0])
        self.chunks = _Chunks(self)

    def single(self, char: str) -> int:
        """An internal id for a character that is no piece."""
        if char not in self.foreign:
            self.foreign[char] = len(self.text)
            self.text.append(char)
            self.length.append(1)
            self.shorter.append(-1)
            self.rank.append(-1)
            self.halves.append((-1, -1))
        return self.foreign[char]

    def merge(self, text: str) -> tuple[list[int], tuple[str, str] | None]:
        """Merge by score, the leftmost first among equals: the pieces, and the halves of the last merge. For single pieces and pairs only."""
        parts, score, halves = list(text), self.score, None
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = score.get(parts[k] + parts[k + 1])
                if found and (best is None or found[0] > best):
                    best, at = found[0], k
            if at < 0:
                break
            halves = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [score[p][1] if p in score else self.foreign.get(p, -2) for p in parts], halves

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both gives this pair: undo their merges, the latest first; at no moment may the pieces
        that then meet at the border have merged earlier than what was undone last."""
        key = (left, right)
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        text, rank, halves = self.text, self.rank, self.halves
        limit, a, b = float("inf"), left, right
        while True:
            both = self.rank_of.get(text[a] + text[b])
            if both is not None and both < limit:
                fits = False
                break
            if rank[a] < 0 and rank[b] < 0:  # single characters
                fits = True
                break
            if rank[a] > rank[b]:
                limit = rank[a]
                a = halves[a][1]
            else:  # at equal rank the border lies to the left of the merge within b and would have come first
                limit = rank[b] + 0.5
                b = halves[b][0]
        self.pairs[key] = fits
        return fits

    def encode_chunk(self, chunk: str) -> list[int]:
        n, length, pairs = len(chunk), self.length, self.pairs
        taken = [i for _, (i, _) in self.automaton.iter_long(chunk)]
        if sum([length[i] for i in taken]) == n:  # the greedy pieces cover the chunk: if all neighbours are compatible, they are the result
            for pair in zip(taken, taken[1:]):
                if not (pairs[pair] if pair in pairs else self.compatible(*pair)):
                    break
            else:
                return taken
        longest = [-1] * n
        for end, (i, size) in self.automaton.iter(chunk):
            longest[end - size + 1] = i  # ends come in order: the last one is the longest
        failed = bytearray((n >> 3) + 1)  # a bit a position
        taken = []
        shorter = self.shorter
        at = 0
        while at < n:
            piece = longest[at]
            if piece < 0:
                piece = longest[at] = self.single(chunk[at])
            while True:
                end = at + length[piece]
                if not failed[end >> 3] & 1 << (end & 7):
                    if not taken:
                        break
                    fits = pairs.get((taken[-1], piece))
                    if fits is None:
                        fits = self.compatible(taken[-1], piece)
                    if fits:
                        break
                piece = shorter[piece]
                while piece < 0:  # no prefix is left: take the last piece back and try what is shorter
                    failed[at >> 3] |= 1 << (at & 7)
                    last = taken.pop()
                    at -= length[last]
                    piece = shorter[last]
            taken.append(piece)
            at = end
        size = len(self.out)
        if max(taken) < size:
            return taken
        ids: list[int] = []
        for i in taken:
            if i < size:
                ids.append(i)
            elif self.byte_id:
                ids += [self.byte_id[b] for b in self.text[i].encode()]
            else:
                ids.append(self.unk)
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text with begin and end, as little-endian unsigned 32-bit integers."""
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        if not text:
            return begin + end
        chunks = self.pattern.findall(SPACE + text.replace(" ", SPACE))
        return begin + b"".join(map(self.chunks.__getitem__, chunks)) + end

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces restored, the first one dropped, byte pieces joined, U+FFFD for each invalid byte."""
        first, last = 0, len(ids)
        while first < last and ids[first] in self.control:
            first += 1
        while first < last and ids[last - 1] in self.control:
            last -= 1
        ids = ids[first:last]
        if not ids:
            return ""
        raw = b"".join(map(self.out.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:  # invalid bytes, or a control piece, which parts the bytes beside it
            runs, at_byte = [bytearray()], False
            for i in ids:
                if (i in self.bytes) != at_byte or i in self.control:
                    runs.append(bytearray())
                    at_byte = i in self.bytes
                if i not in self.control:
                    runs[-1] += self.out[i]
            text = "".join(x.decode("utf-8", "paperlens_byte") for x in runs)
        lead = next((self.text[i] for i in ids if i not in self.control), "")
        return text[1:] if lead.startswith(SPACE) else text


def codec(path: str) -> PieceCodec:
    """One codec a worker and model."""
    return held(f"codec {path}", lambda: PieceCodec(path))


def encode(df: DataFrame, model: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with an array<int> column of piece ids, begin and end included. model: path of a .model file on every node."""

    def work(batches):
        c = codec(model)
        for batch in batches:
            ids = [np.frombuffer(c.encode(t), "<u4").astype("int32") for t in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype="int32")
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, "int32")])))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), column], [*keep, into])

    keep = [c for c in df.columns if c != into]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(into, T.ArrayType(T.IntegerType()))])
    return bounded(df).select(*(f"`{c}`" for c in keep)).mapInArrow(work, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the text of a column of piece ids; null ids give an empty text."""

    def work(batches):
        c = codec(model)
        for batch in batches:
            texts = [c.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(texts, pa.string())], [*keep, into])

    keep = [c for c in df.columns if c != into]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(into, T.StringType())])
    return bounded(df).select(*(f"`{c}`" for c in keep)).mapInArrow(work, schema)


def round_trip(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode its ids: key, n_tokens, ids_sha256, decoded_sha256. Ids and texts never leave the worker."""

    def work(batches):
        c = codec(model)
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                ids = c.encode(t)
                back = c.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            counts, first, second = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = T.StructType(
        [df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )
    return bounded(df).select(key, text).mapInArrow(work, schema)
