"""Greedy packing of ordered rows into batches, with no group in one task.

Rows are dealt by ranges of (group, order); a range is a chunk, and a group's rows in it a segment. Where the batch that is open at a segment's
beginning ends depends on the segments before, but it ends within the limit's number of rows. So each segment first says, for
each of these rows, how a segment goes on if a batch begins there (batches begun, items and size of the one left open): a small
row a segment. These rows alone are then walked in order, group by group, and give the batch that is open where each segment
begins. With that the segments are packed, each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paperlens.operators.grouped import walked
from paperlens.sources.scratch import once

#: Segments up to which their entries are broadcast.
BROADCAST_ROWS = 100_000


def exits(sizes: list[int], most: int, characters: int) -> list[tuple[int, int, int]]:
    """For each of the first `most` rows: batches begun up to the end if one begins there, and items and size of the last."""
    n, sums = len(sizes), [0, *accumulate(sizes)]
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * n
    end = n
    for i in range(n - 1, -1, -1):
        while end > i + 1 and (end - i > most or sums[end] - sums[i] > characters):
            end -= 1
        out[i] = (1, n - i, sums[n] - sums[i]) if end == n else (out[end][0] + 1, *out[end][1:])
    return out[:most]


def packed(rows: DataFrame, group: str, order: list[str], size: str, most: int, characters: int) -> DataFrame:
    """rows with batch (from 0 in each group): greedy, in order, closed at `most` items or before `characters` are passed; a longer item
    is alone. A null size counts as 0. Rows should be narrow: keys and lengths."""
    keyed = rows.repartitionByRange(group, *order).withColumns({"_chunk": F.spark_partition_id(), "_size": F.coalesce(F.col(size).cast("long"), F.lit(0))})
    keyed = once(keyed, "chunks")
    number = lambda n: T.StructField(n, T.LongType())
    step = T.ArrayType(T.StructType([number("begun"), number("items"), number("size")]))
    lists = T.StructType([keyed.schema["_chunk"], rows.schema[group], T.StructField("head", T.ArrayType(T.LongType())), T.StructField("exits", step), number("n"), number("total")])

    def segment(found: list) -> list[tuple]:
        out = []
        for g, own in groupby(found, key=lambda r: r[1]):
            sizes = [r[2] for r in own]
            out.append((found[0][0], g, sizes[:most], [dict(zip(("begun", "items", "size"), e, strict=True)) for e in exits(sizes, most, characters)], len(sizes), sum(sizes)))
        return out

    narrow = keyed.select(F.col("_chunk").alias("chunk"), F.col(group).alias("g"), F.col("_size").alias("n"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    heads = walked(narrow, ["chunk"], [F.col("g"), *(F.col(f"o{i}") for i in range(len(order)))], segment, lists)
    entry = T.StructType([keyed.schema["_chunk"], rows.schema[group], number("batch"), number("items"), number("total")])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, batch, items, total = object(), 0, 0, 0
        for rows_ in batches:
            out = []
            for chunk, g, head, ways, n, whole in zip(*(c.to_pylist() for c in rows_.columns), strict=True):
                if g != at:
                    at, batch, items, total = g, 0, 0, 0
                out.append((chunk, g, batch, items, total))
                for i, s in enumerate(head):
                    if items and (items >= most or total + s > characters) or not items and i == 0:
                        way = ways[i]
                        batch, items, total = batch + way["begun"] - (not items), way["items"], way["size"]
                        break
                    items, total = items + 1, total + s
                else:  # the open batch takes the whole segment
                    assert n == len(head)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], entry.names)

    kinds = [to_arrow_type(f.dataType) for f in entry]
    entries = once(heads.repartition(group).sortWithinPartitions(group, "_chunk").mapInArrow(follow, entry), "entries")
    entries = F.broadcast(entries) if entries.count() <= BROADCAST_ROWS else entries
    given = keyed.join(entries.withColumnsRenamed({group: "_g", "_chunk": "_c", "batch": "_batch", "items": "_items", "total": "_total"}), F.expr(f"_chunk = _c AND `{group}` <=> _g")).drop("_c", "_g")
    place, own_columns = {c: i for i, c in enumerate(given.columns)}, len(rows.columns)

    def pack(found: list) -> list[tuple]:
        result = []
        for _, own in groupby(found, key=lambda r: r[place[group]]):
            batch = items = total = None
            for r in own:
                if batch is None:
                    batch, items, total = r[place["_batch"]], r[place["_items"]], r[place["_total"]]
                s = r[place["_size"]]
                if items and (items >= most or total + s > characters):
                    batch, items, total = batch + 1, 0, 0
                items, total = items + 1, total + s
                result.append((*r[:own_columns], batch))
        return result

    # Columns go by place: the walk's rows are named tuples, whose fields cannot have every name.
    names = [f"c{i}" for i in place.values()]
    by = [F.col(names[place[c]]) for c in (group, *order)]
    return walked(given.toDF(*names), [names[place["_chunk"]]], by, pack, T.StructType([*rows.schema.fields, number("batch")]))
