"""Token counts without token ids: pieces are counted once per distinct pre-token and summed per document.

1. Tasks split texts into pre-tokens and write, for each block of documents, one row per distinct pre-token with the
   packed (document, frequency) pairs of the block: a word costs its string once a block, not once a document.
2. The rows are dealt by pre-token and sorted by its hash (a radix sort), so that each distinct pre-token meets the tokenizer once; it is joined to
   its frequencies there, and the products are summed per block before they move again. Pre-tokens that many documents of
   a block hold are spread over more keys (the salt grows with that number), so no word piles up in one task.
3. The sums of a block meet in one group, bounded by the size of a block.

Null text counts as empty (0 bytes, 0 tokens). Repeated rows and repeated or null ids give one row each. Clashing columns
of the input are not carried over.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paperlens.llm.common import held

#: Characters whose classes are the same in every Unicode version that the library could have been built with.
SAFE_END = 0x250
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 60_000
#: Documents of a block that hold a pre-token, for each key that it is dealt to.
SALT_STEP = 32
#: Pre-tokens that go to the library at once.
AT_ONCE = 20_000
#: Pairs that a task holds before it sends their sums on.
FLUSH_PAIRS = 4_000_000


def _ranges(kind: str) -> str:
    found = [c for c in range(SAFE_END) if unicodedata.category(chr(c)).startswith(kind)]
    out, k = [], 0
    while k < len(found):
        end = k
        while end + 1 < len(found) and found[end + 1] == found[end] + 1:
            end += 1
        out.append(f"\\u{found[k]:04x}-\\u{found[end]:04x}")
        k = end + 1
    return "".join(out)


class PreTokens:
    """Splits texts as the byte-level pre-tokenizer of a tokenizers file does, and counts the tokens of the parts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.parts = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        letter, number, space = _ranges("L"), _ranges("N"), "\\t-\\r \\x85\\xa0"
        self.fast = re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.other = re.compile(f"[^\\x00-{chr(SAFE_END - 1)}]")

    def split(self, text: str) -> list[str]:
        if self.parts and any(t in text for t in self.added):
            out: list[str] = []
            for part in self.parts.split(text):
                if part in self.added:
                    out.append(part)
                elif part:
                    out += self._split(part)
            return out
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not self.other.search(text):
            return self.fast.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, parts: list[str]) -> np.ndarray:
        return np.fromiter((len(x.ids) for x in self.library.encode_batch(parts, add_special_tokens=False)), "int64", len(parts))


def splitter(path: str) -> PreTokens:
    return held(f"splitter {path}", lambda: PreTokens(path))


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _block(texts: list[str | None], s: PreTokens):
    """Distinct pre-tokens of a block, and for each its packed pairs: document number in the upper 16 bits, frequency below."""
    numbers = _Numbers()
    ids, sizes = [], []
    for t in texts:
        parts = s.split(t) if t else []
        ids.append(np.fromiter(map(numbers.__getitem__, parts), "int64", len(parts)))
        sizes.append(len(parts))
    docs = np.repeat(np.arange(len(texts), dtype="int64"), sizes)
    keys, freqs = np.unique((np.concatenate([*ids, np.empty(0, "int64")]) << 16) | docs, return_counts=True)
    while (freqs > 0xFFFF).any():  # more than 16 bits hold: several pairs
        big = freqs > 0xFFFF
        keys, freqs = np.concatenate([keys, keys[big]]), np.concatenate([np.where(big, 0xFFFF, freqs), freqs[big] - 0xFFFF])
    order = np.argsort(keys, kind="stable")
    keys, freqs = keys[order], freqs[order]
    pairs = (((keys & 0xFFFF) << 16) | freqs).astype("<u4")
    held = np.bincount(keys >> 16, minlength=len(numbers))
    return list(numbers), pairs, np.concatenate([[0], np.cumsum(held)])


def pre_token_frequencies(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of one distinct pre-token of one block with packed frequencies, and one row per block with its keys and sizes."""

    def work(batches):
        s = splitter(tokenizer)
        task, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            sizes = np.fromiter((len(t.encode()) if t else 0 for t in texts), "int64", len(texts))
            first = 0
            while first < len(texts):
                end = first + max(1, int(np.searchsorted(np.cumsum(sizes[first : first + BLOCK_DOCS]), BLOCK_BYTES)))
                end = min(end, len(texts))
                parts, pairs, ends = _block(texts[first:end], s)
                block, n = task | n, n + 1
                packed = pa.array([], pa.binary())
                if parts:
                    packed = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer((ends * 4).astype("int32")), pa.py_buffer(pairs.tobytes())])
                own = _to_bytes(pa.RecordBatch.from_arrays([keys.slice(first, end - first), pa.array(sizes[first:end])], ["key", "n_bytes"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*parts, None], pa.string()),
                        pa.array([*((block * 7 + (block >> 32)) % (1 + np.diff(ends) // SALT_STEP)), block], pa.int64()),
                        pa.array([block] * (len(parts) + 1), pa.int64()),
                        pa.concat_arrays([packed, pa.array([own], pa.binary())]),
                    ],
                    names,
                )
                first = end

    names = ["part", "salt", "block", "packed"]
    return df.select(key, text).mapInArrow(work, "part string, salt long, block long, packed binary")


# Keys and sizes of a block travel as bytes: Spark measures list columns anew for every row that it sends to a task.
def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _sums(tokenizer: str):
    """Rows sorted by pre-token in; per block the (document, tokens) sums of this task out."""
    names = ["block", "own", "packed"]

    def flush(held):
        blocks = []
        for block, parts in held.items():
            pairs, counts = np.concatenate([p for p, _ in parts]), np.repeat([c for _, c in parts], [len(p) for p, _ in parts])
            total = np.bincount((pairs >> 16).astype("int64"), weights=(pairs & 0xFFFF) * counts).astype("int64")
            where = np.flatnonzero(total)
            blocks.append((block, np.stack([where, total[where]]).astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int64()), pa.array([False] * len(blocks)), pa.array([x for _, x in blocks], pa.binary())], names)

    def work(batches):
        s = splitter(tokenizer)
        held: dict[int, list] = {}
        size, last, last_count = 0, None, 0
        for batch in batches:
            own = batch.filter(pc.is_null(batch.column(0)))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(1), pa.array([True] * own.num_rows), own.column(2)], names)
            batch = batch.filter(pc.is_valid(batch.column(0)))
            for first in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(first, AT_ONCE)
                parts = rows.column(0).to_pylist()
                distinct = list(dict.fromkeys(p for p in parts if p != last))
                counts = dict(zip(distinct, s.count(distinct).tolist(), strict=True))
                counts[last] = last_count
                for part, block, packed in zip(parts, rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    pairs = np.frombuffer(packed, "<u4")
                    size += len(pairs) + 8
                    held.setdefault(block, []).append((pairs, counts[part]))
                last, last_count = parts[-1], counts[parts[-1]]
                if size > FLUSH_PAIRS:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return work


def token_counts(df: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit. tokenizer: path of a tokenizers .json on every node."""
    spark = df.sparkSession
    rows = pre_token_frequencies(df, tokenizer, key, text)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "part", "salt").sortWithinPartitions(F.xxhash64("part")).select("part", "block", "packed")
    sums = dealt.mapInArrow(_sums(tokenizer), "block long, own boolean, packed binary")
    key_type = to_arrow_type(df.schema[key].dataType)

    def finish(group: pa.Table) -> pa.Table:
        rows = list(zip(group.column("own").to_pylist(), group.column("packed").to_pylist(), strict=True))
        block = pa.ipc.open_stream(next(x for own, x in rows if own)).read_all()
        total = np.zeros(len(block), "int64")
        for own, packed in rows:
            if not own:
                where, counts = np.frombuffer(packed, "<u4").reshape(2, -1)
                total[where] += counts
        return pa.table([block.column("key").cast(key_type), block.column("n_bytes"), pa.array(total)], names=[key, "n_bytes", "n_tokens"])

    schema = T.StructType([df.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return sums.groupBy("block").applyInArrow(finish, schema).withColumn("over_limit", F.col("n_tokens") > limit)
