"""Groups that only code can walk: rows are dealt and sorted by Spark, a task walks its groups one after another."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

#: Rows that a task gathers before it sends them on.
ROWS = 10_000


def walked(rows: DataFrame, keys: list[str], order: list[Column], walk: Callable[[list], list[tuple]], schema: T.StructType) -> DataFrame:
    """walk(rows of one key, in order) -> tuples of the schema, for every key. One group is in memory at a time."""
    columns, fields = rows.columns, to_arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = namedtuple("row", columns)

        def sent(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

        out: list[tuple] = []
        for _, group in groupby((r for b in batches for r in map(row._make, zip(*(c.to_pylist() for c in b.columns[:-1]), strict=True))), key=attrgetter(*keys)):
            out += walk(list(group))
            if len(out) >= ROWS:
                yield sent(out)
                out = []
        if out:
            yield sent(out)

    # A window asks for groups that lie together and in order, and shuffles only rows that are not dealt by these keys yet.
    dealt = rows.withColumn("walk order", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return dealt.mapInArrow(task, schema)
