"""Vector codes by product quantisation: vectors cut into parts, a codebook for each part position, nearest entries by memoised
grid cells.

1. Components become integers, floor(4096 * x). Rows whose vector is null or holds a null or non-finite component are dropped.
2. Codebooks start as the parts of the 16 smallest ids. In each round Spark's tasks assign their parts and send one row of sums
   an entry and component; the driver holds codebooks alone (16 entries, whatever the table has).
3. A part's coarse cell (components shifted right) is hashed. Of a cell that was not seen before, the cache keeps the entries
   that are not dominated in its box: an entry whose smallest distance to the box exceeds the largest of another is nearest to
   no point there. Exact distances are taken to the cached entries alone; ties go to the lower index. Cells are kept beside
   their hash: two cells of one hash are told apart, and the later one is held against all entries. The cache is bounded.

Fewer than 16 vectors give as many entries. Repeated ids are ordered by their vectors, null ids come last. A vector of another
length than that of the first row keeps its row with a null code and null errors. Where the length is no multiple of 8 the
first parts have one component more. Components are cut off at the largest power of two for which squared distances fit 64 bits (2**27, that
is |x| up to 32768, for 64 components). Labels can be null; nulls are one label. An empty table gives an empty result. Other
columns are not carried over.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlens.llm.common import bounded, discard, held, small, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Cells that a part's cache holds.
CACHE_CELLS = 1 << 16


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label and the components as integers of the rows whose vector is whole."""
    whole = F.expr(f"`{vector}` IS NOT NULL AND forall(`{vector}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    most = F.expr(f"shiftleft(1L, int(least(27, (62 - ceil(log2(greatest(1, size(`{vector}`))))) / 2 - 1)))")
    rows = df.where(whole).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"), most.alias("most"))
    return rows.select("id", "label", F.expr(f"transform(v, x -> int(greatest(-most, least(most, floor(double(x) * {SCALE})))))").alias("v"))


def cuts(dim: int, parts: int = PARTS) -> list[slice]:
    ends = np.cumsum([0] + [dim // parts + (i < dim % parts) for i in range(parts)])
    return [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Cells:
    """Entries that can be nearest to some point of a coarse cell, for the cells seen so far of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.all = entries, np.uint32((1 << len(entries)) - 1)
        spread = int(entries.std(axis=0).mean()) if entries.size else 1
        self.shift = max(0, spread.bit_length() - 1)
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.cells, self.masks = np.empty(0, "uint64"), np.empty((0, self.entries.shape[1]), "int64"), np.empty(0, "uint32")

    def _hash(self, cells: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cells), "uint64")
        for column in cells.T:
            out = (out ^ column.astype("uint64")) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        low = cells << self.shift
        high = low + (1 << self.shift) - 1
        least, most = np.empty((len(cells), len(self.entries)), "int64"), np.empty((len(cells), len(self.entries)), "int64")
        for j, e in enumerate(self.entries):
            below, above = low - e, high - e
            least[:, j] = (np.maximum(np.maximum(below, -above), 0) ** 2).sum(axis=1)
            most[:, j] = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)
        open_ = least <= most.min(axis=1, keepdims=True)
        return (open_.astype("uint32") << np.arange(len(self.entries), dtype="uint32")).sum(axis=1, dtype="uint32")

    def masks_of(self, points: np.ndarray) -> np.ndarray:
        cells = points >> self.shift
        hashes = self._hash(cells)
        new, first = np.unique(hashes, return_index=True)
        unseen = ~np.isin(new, self.hashes, assume_unique=True)
        if unseen.any():
            if len(self.hashes) + unseen.sum() > CACHE_CELLS:
                self._clear()
                unseen[:] = True
            at = first[unseen]
            order = np.argsort(merged := np.concatenate([self.hashes, new[unseen]]), kind="stable")
            self.hashes = merged[order]
            self.cells = np.concatenate([self.cells, cells[at]])[order]
            self.masks = np.concatenate([self.masks, self._undominated(cells[at])])[order]
        place = np.searchsorted(self.hashes, hashes)
        return np.where((self.cells[place] == cells).all(axis=1), self.masks[place], self.all)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each point's nearest entry and the squared distance."""
        masks = self.masks_of(points)
        best, index = np.full(len(points), np.iinfo("int64").max), np.zeros(len(points), "int64")
        for j, e in enumerate(self.entries):
            rows = np.flatnonzero(masks >> np.uint32(j) & np.uint32(1))
            distance = ((points[rows] - e) ** 2).sum(axis=1)
            closer = distance < best[rows]
            best[rows[closer]], index[rows[closer]] = distance[closer], j
        return index, best


def _assign(books: list[np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part (rows x parts)."""
    digest = hashlib.blake2b(b"".join(b.tobytes() for b in books)).hexdigest()
    caches = held(f"cells {digest}", lambda: [Cells(b) for b in books])
    found = [c.nearest(vectors[:, cut]) for c, cut in zip(caches, cuts(vectors.shape[1], len(books)), strict=True)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _vectors(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim).astype("int64")


def entry_sums(rows: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """part, entry, position, total, n over all rows: v."""

    def work(batches):
        totals, counts = [np.zeros(b.shape, "int64") for b in books], [np.zeros(len(b), "int64") for b in books]
        for batch in batches:
            if batch.num_rows:
                vectors = _vectors(batch, "v", dim)
                index, _ = _assign(books, vectors)
                for p, cut in enumerate(cuts(dim, len(books))):
                    np.add.at(totals[p], index[:, p], vectors[:, cut])
                    counts[p] += np.bincount(index[:, p], minlength=len(counts[p]))
        out = [(p, e, i, int(totals[p][e, i]), int(counts[p][e])) for p in range(len(books)) for e in np.flatnonzero(counts[p]) for i in range(totals[p].shape[1])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["part", "entry", "position", "total", "n"])

    sums = bounded(rows).select("v").mapInArrow(work, "part long, entry long, position long, total long, n long")
    return sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def trained(rows: DataFrame, dim: int, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> list[np.ndarray]:
    """Codebooks (entries x components) of the parts; rows: id, v."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([r.v for r in first], "int64").reshape(len(first), dim)
    books = [start[:, cut].copy() for cut in cuts(dim, parts)]
    for _ in range(rounds):
        for r in entry_sums(rows, books, dim).collect():
            books[r.part][r.entry, r.position] = r.total // r.n
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded(rows: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """id, label, code (two hex digits a part), error of rows: id, label, v."""

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                index, error = _assign(books, _vectors(batch, "v", dim))
                codes = [r.tobytes().hex() for r in index.astype("uint8")]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes), pa.array(error.sum(axis=1))], ["id", "label", "code", "error"])

    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return bounded(rows).select("id", "label", "v").mapInArrow(work, schema)


def vector_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 of each usable row."""
    rows = stored(usable(df, key, vector, label), "integers")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("dim")).first()
    dim = first.dim if first else 0
    fitting, other = rows.where(F.size("v") == dim), rows.where(F.size("v") != dim)
    books = trained(fitting, dim)
    codes = coded(fitting, books, dim).union(other.select("id", "label", F.lit(None).cast("string"), F.lit(None).cast("long")))
    codes = stored(codes, "codes")
    discard(rows)
    totals = small(stored(codes.where("error IS NOT NULL").groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors"))
    both = codes.join(totals, F.col("label").eqNullSafe(F.col("of")) & F.col("error").isNotNull(), "left")
    return both.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
