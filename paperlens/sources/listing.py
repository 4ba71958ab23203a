"""Files below a folder as rows. Tasks list them, so the driver holds no names, however many files there are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = pa.schema([("file", pa.string()), ("size", pa.int64())])
ROWS = 10_000


def place(path: str):
    """The store of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def tasks(spark: SparkSession) -> int:
    """How many tasks share the files, whatever the number of partitions after an exchange is set to."""
    return 4 * spark.sparkContext.defaultParallelism


def _below(path: str, folder: str, deep: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, base = place(path)
    found = store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, recursive=deep, allow_not_found=True))
    for at in range(0, len(found), ROWS):
        some = [(f.path[len(base) :].lstrip("/"), f.size if f.type == fs.FileType.File else None) for f in found[at : at + ROWS] if not deep or f.type == fs.FileType.File]
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in some], f.type) for i, f in enumerate(_FIELDS)], schema=_FIELDS)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """file (its path within the folder) and size. One task lists the folder itself, others one of its sub-folders each, with all below."""

    def top(batches):
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                yield from _below(path, folder, False)

    def below(batches):
        for batch in batches:
            yield batch.filter(batch.column("size").is_valid())
            for folder, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size is None:
                    yield from _below(path, folder, True)

    kind = "file string, size long"
    # Of an RDD Spark takes no row to be one file, so it does not plan to broadcast what comes of the files before it knows how many there are.
    whole = spark.createDataFrame(spark.sparkContext.parallelize([("",)], 1), "folder string")
    return whole.mapInArrow(top, kind).repartition(tasks(spark)).mapInArrow(below, kind)


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    return listed(spark, path).where(F.lower("file").endswith(".pdf"))
