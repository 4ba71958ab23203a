"""Ranked lexical search: a set of items against all documents, by branch and bound over document tries.

1. Documents are restricted to the terms of the items: pairs of term and frequency, beside the number of all their terms. The
   counts that weights need (N, L, df) are taken over all documents from these rows.
2. A task gathers its documents in blocks of bounded size. A document's vector is ordered by document frequency, the commonest
   term first, and led by the magnitude of its length norm m; documents in the order of these sequences form a trie (an
   FP-tree): neighbours share its paths. Subtrees of up to LEAF_DOCS documents are its leaves.
3. Each node keeps, for each term in its subtree, the largest frequency, and the smallest m. With these the score of any
   document below is bounded from above, since scores rise with frequencies and fall with m. Each item walks the trie depth first, best
   bound first, and leaves out subtrees whose bound is under its tenth score so far; leaves are scored exactly. The scores of
   a task's earlier blocks bound its later ones.
4. A task returns its ten best documents an item; a window ranks these.

Documents without a term count nowhere and are never returned. Repeated rows are documents of their own; null ids come after
others of equal score. Items with one id are one item with the terms of all its rows; items without terms, or without documents
of a score above 0, have no row. Items are taken in blocks of bounded size, whatever their number; texts are taken whole. Other columns are
not carried over. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from paperlens.llm.common import bounded, discard, stored

#: Pairs of item and term that one pass over the documents searches for.
ITEM_TERMS = 200_000
#: Documents and vector entries of a trie, and documents of a leaf.
BLOCK_DOCS, BLOCK_ENTRIES, LEAF_DOCS = 16_384, 1_000_000, 64
#: Parameters of the score, in hundredths: lengths count with B of 100; K is the weight of the norm in a term's part.
B, K = 90, 8
_DELIMITERS = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes.maketrans(_DELIMITERS + bytes(range(65, 91)), b" " * len(_DELIMITERS) + bytes(range(97, 123)))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all signs beyond ASCII; A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """id, term: the distinct terms of each item."""

    def work(batches):
        for batch in batches:
            found = [(i, t) for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()) for t in dict.fromkeys(terms_of(text))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([t for _, t in found], pa.binary())], ["id", "term"])

    schema = T.StructType([T.StructField("id", items.schema[key].dataType), T.StructField("term", T.BinaryType())])
    return bounded(items).select(key, text).mapInArrow(work, schema).distinct()


def restricted(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """id, n (all terms), terms (numbers in the vocabulary), counts of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches):
        number = shared.value.get
        for batch in batches:
            sizes, terms, counts, at = [], [], [], [0]
            for raw in batch.column(1).cast(pa.binary()):
                words = terms_of(raw.as_py())
                found = Counter(map(number, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms.append(np.fromiter(found.keys(), "int32", len(found)))
                counts.append(np.fromiter(found.values(), "int32", len(found)))
                at.append(at[-1] + len(found))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(x) if x else np.empty(0, "int32"))) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("terms", ints), T.StructField("counts", ints)])
    return bounded(docs).select(key, text).mapInArrow(work, schema)


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1_000 * tf + K * m)


class Trie:
    """Documents of a block in the order of their sequences, the nodes over them, and per term the nodes that hold it.

    terms, counts: flat vectors (terms as ranks, ascending within a document); ends: where each document's vector ends."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, ends: np.ndarray, m: np.ndarray, ids: np.ndarray, keep: int):
        begins = np.concatenate([[0], ends[:-1]])
        lead = np.frexp(m.astype("float64"))[1].astype(">u4")
        raw, coded = terms.astype(">u4").tobytes(), counts.astype(">u4").tobytes()
        paths = [lead[i].tobytes() + raw[4 * a : 4 * b] for i, (a, b) in enumerate(zip(begins, ends, strict=True))]
        # Documents alike in vector and norm come by their ids; those behind the first ones of a kind can be in no result.
        kinds = [(path, coded[4 * a : 4 * b], n) for path, a, b, n in zip(paths, begins, ends, m.tolist(), strict=True)]
        order, kind, run = [], None, 0
        for i in sorted(range(len(paths)), key=lambda i: (kinds[i], ids[i])):
            run = run + 1 if kinds[i] == kind else 0
            kind = kinds[i]
            if run < keep:
                order.append(i)
        self.docs, self.m = np.array(order), m[order]
        lengths = (ends - begins)[order]
        self.ends = np.cumsum(lengths)
        flat = np.repeat(begins[order] - (self.ends - lengths), lengths) + np.arange(lengths.sum())
        self.terms, self.counts = terms[flat], counts[flat]
        self._grow([paths[i] for i in order])

    def _grow(self, paths: list[bytes]) -> None:
        """Nodes: first and last document, children. A child is a branch of the shared path, or neighbouring branches of up to
        LEAF_DOCS documents together; a branch with over half of its parent's documents gives its own branches instead, so that no
        document is below more nodes than the logarithm of the block's size."""
        shared = np.array([_common(a, b) for a, b in zip(paths, paths[1:], strict=False)], "int64")
        self.first, self.last, self.children = [0], [len(paths)], [[]]

        def branches(a: int, b: int, half: float) -> list[int]:
            before, after = [], []
            while True:
                inner = shared[a : b - 1]
                out = [a, *(a + 1 + np.flatnonzero(inner == inner.min())).tolist(), b]
                heavy = next((i for i, (x, y) in enumerate(zip(out[:-1], out[1:], strict=True)) if y - x > max(half, LEAF_DOCS)), None)
                if heavy is None:
                    return before + out + after[::-1]
                before += out[:heavy]
                after += out[: heavy + 1 : -1]
                a, b = out[heavy], out[heavy + 1]

        waiting = [0]
        while waiting:
            node = waiting.pop()
            a, b = self.first[node], self.last[node]
            if b - a <= LEAF_DOCS:
                continue
            starts = branches(a, b, (b - a) / 2)
            cut = [a]
            for x, y in zip(starts[:-1], starts[1:], strict=True):
                if y - cut[-1] > LEAF_DOCS and x > cut[-1]:
                    cut.append(x)
            for x, y in zip(cut, [*cut[1:], b], strict=True):
                self.children[node].append(len(self.first))
                waiting.append(len(self.first))
                self.first.append(x)
                self.last.append(y)
                self.children.append([])
        # Of each node the smallest norm and, by term, the largest count in its subtree.
        begins, low, found = np.concatenate([[0], self.ends]), [], []
        for node, (a, b) in enumerate(zip(self.first, self.last, strict=True)):
            low.append(self.m[a:b].min())
            terms, counts = self.terms[begins[a] : begins[b]], self.counts[begins[a] : begins[b]]
            order = np.argsort(terms, kind="stable")
            own, at = np.unique(terms[order], return_index=True)
            found.append((own, np.full(len(own), node, "int32"), np.maximum.reduceat(counts[order], at)))
        self.low = np.array(low)
        terms, nodes, most = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(terms, kind="stable")
        self.of_term, self.nodes, self.most = terms[order], nodes[order], most[order]

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No document below a node scores more than its bound."""
        out = np.zeros(len(self.first), "int64")
        for t, w in zip(terms, weights, strict=True):
            a, b = np.searchsorted(self.of_term, [t, t + 1])
            nodes = self.nodes[a:b]
            out[nodes] += w * part(self.most[a:b].astype("int64"), self.low[nodes])
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, least: int, offer: Callable[[list[tuple[int, int]]], int]) -> None:
        """Offers (document, score) of all documents that can be among the best; least: the score that these have at least, and
        what offer gives back. dense: zeros for all terms, left so."""
        bounds = self.bounds(terms, weights)
        begins = np.concatenate([[0], self.ends])
        dense[terms] = weights
        waiting = [0]
        while waiting:
            node = waiting.pop()
            if bounds[node] < least:
                continue
            if below := self.children[node]:
                waiting += sorted((c for c in below if bounds[c] >= least), key=bounds.__getitem__)
                continue
            a, b = self.first[node], self.last[node]
            x, y = begins[a], begins[b]
            w = dense[self.terms[x:y]]
            hit = np.flatnonzero(w)
            doc = np.searchsorted(self.ends, x + hit, side="right")
            scores = np.zeros(b - a, "int64")
            np.add.at(scores, doc - a, w[hit] * part(self.counts[x + hit].astype("int64"), self.m[doc]))
            best = np.flatnonzero(scores >= least)
            if len(best):
                least = offer([(int(self.docs[a + i]), int(scores[i])) for i in best])
        dense[terms] = 0


def _common(a: bytes, b: bytes) -> int:
    """Terms that two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    x, y = np.frombuffer(a, ">u4", n // 4), np.frombuffer(b, ">u4", n // 4)
    return int((x != y).argmax())


class Best:
    """The first k of (score, id) by falling score and rising id, nulls last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, rows: list[tuple[int, object]]) -> int:
        self.rows = sorted([*self.rows, *rows], key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))[: self.k]
        return self.least


def found_in(vectors: DataFrame, items: list[tuple[object, list[int]]], ranks: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, k: int, key_type) -> DataFrame:
    """item_id, id, score: of each task the k best documents of each item. items: id and term numbers; ranks, weights: by term number."""
    shared = vectors.sparkSession.sparkContext.broadcast(([(i, ranks[t], weights[t]) for i, t in items], ranks))
    schema = T.StructType([T.StructField("item_id", key_type), vectors.schema["id"], T.StructField("score", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def work(batches):
        items, ranks = shared.value
        best = [Best(k) for _ in items]
        dense = np.zeros(len(ranks), "int64")

        def block(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids = table.column(0).combine_chunks()
            place = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
            terms, counts = (c.combine_chunks() for c in table.columns[2:])
            ends = np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            flat, amount = ranks[terms.flatten().to_numpy()], counts.flatten().to_numpy()
            doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
            order = np.lexsort((flat, doc))
            m = 100 - B + (B * table.column(1).to_numpy() * n_docs) // n_terms
            trie = Trie(flat[order], amount[order], ends, m, place, k)
            for own, (_, terms_, weights_) in zip(best, items, strict=True):
                trie.search(terms_, weights_, dense, own.least, lambda rows, own=own: own.add([(score, ids[d].as_py()) for d, score in rows]))

        parts, docs, entries = [], 0, 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
            for at in range(0, batch.num_rows, 1_000):
                some = batch.slice(at, 1_000)
                parts.append(some)
                docs, entries = docs + some.num_rows, entries + len(some.column(2).flatten())
                if docs >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    block(parts)
                    parts, docs, entries = [], 0, 0
        if parts:
            block(parts)
        rows = [(i, d, score) for own, (i, _, _) in zip(best, items, strict=True) for score, d in own.rows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["item_id", "id", "score"])

    return bounded(vectors).mapInArrow(work, schema)


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, rank, key, score: the k documents of the highest score above 0 of each item."""
    kind = items.schema[item].dataType
    pairs = stored(item_terms(items, item, item_text), "item-terms")
    blocks = math.ceil(pairs.count() / ITEM_TERMS)
    tops = []
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).groupBy("id").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()
        vocabulary = {t: n for n, t in enumerate(sorted({bytes(t) for r in own for t in r.terms}))}
        vectors = stored(restricted(docs, vocabulary, key, text), "vectors")
        n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), "int64")
        for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r.term] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], "int64")
        ranks = np.empty(len(df), "int64")
        ranks[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        chosen = [(r.id, np.array([vocabulary[bytes(t)] for t in r.terms])) for r in own]
        tops.append(stored(found_in(vectors, chosen, ranks, weights, n_docs, max(n_terms, 1), k, kind), "tops"))
        discard(vectors)
    discard(pairs)
    if not tops:
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField(item, kind), T.StructField("rank", T.IntegerType()), T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.LongType())]))
    top = tops[0]
    for more in tops[1:]:
        top = top.union(more)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return top.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("item_id").alias(item), "rank", F.col("id").alias(key), "score")
