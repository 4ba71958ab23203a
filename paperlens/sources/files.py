"""Files in, tables out: page extraction and OCR by pluggable providers, CSV with a byte-order mark, partition overwrite."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paperlens.functions import quality as Q

#: Bytes of an Arrow batch of files where the session sets no bound; batches of pages hold a quarter of it.
BATCH_BYTES = 4 << 20
BOM = "﻿"


class PageExtractor(Protocol):
    """Texts of a file's pages, in order."""

    def pages(self, content: bytes) -> Iterator[str]: ...


class OcrEngine(Protocol):
    """Text and confidence of one page of a file; made once a task, and only when a page needs it."""

    def recognise(self, content: bytes, page_number: int) -> tuple[str, float]: ...


def bounded(df: DataFrame) -> DataFrame:
    """df, once Arrow batches to Python are bounded in bytes; a bound that the session already sets stays."""
    setting, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(setting, None) is None:
        conf.set(setting, str(BATCH_BYTES))
    return df


def batches_of(rows: Iterator[tuple], fields: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches that end once their texts (the column with this place) reach a bound, so that a worker holds few of them."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[text] or "") + 64
        if size >= BATCH_BYTES // 4:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), fields, strict=True)], schema=fields)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), fields, strict=True)], schema=fields)


def extracted(files: DataFrame, extractor: PageExtractor, key: str = "file_id", content: str = "content") -> DataFrame:
    """key, page_number, raw_text, error of each page; a file that fails becomes one row with its error."""
    schema = T.StructType([files.schema[key], T.StructField("page_number", T.IntegerType()), T.StructField("raw_text", T.StringType()), T.StructField("error", T.StringType())])
    fields = to_arrow_schema(schema)

    def pages(k, data) -> list[tuple]:
        try:
            return [(k, n, text, None) for n, text in enumerate(extractor.pages(bytes(data or b"")), 1)]
        except Exception as e:  # noqa: BLE001  a broken file becomes a row
            return [(k, 0, None, f"{type(e).__name__}: {e}")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for b in batches for k, data in zip(b.column(0), b.column(1), strict=True) for row in pages(k.as_py(), data.as_py()))
        yield from batches_of(found, fields, 2)

    return bounded(files.select(key, content)).mapInArrow(work, schema)


def recognised(pages: DataFrame, files: DataFrame, engine: Callable[[], OcrEngine], key: str = "file_id", content: str = "content", mode: str = "auto") -> DataFrame:
    """pages with ocr_text, confidence and source; only pages whose text is missing or garbled are read again."""
    rated = pages.withColumns({"garbled": Q.quality(F.coalesce("raw_text", F.lit(""))).garbled})
    rated = rated.withColumn("wanted", Q.wants_ocr(F.coalesce("raw_text", F.lit("")), F.col("garbled"), mode) & F.col("error").isNull())
    schema = T.StructType([pages.schema[key], T.StructField("page_number", T.IntegerType()), T.StructField("ocr_text", T.StringType()), T.StructField("confidence", T.DoubleType())])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = None
        for frame in frames:
            rows = []
            for k, n, data in zip(frame[key], frame["page_number"], frame[content], strict=True):
                reader = reader or engine()
                rows.append((k, n, *reader.recognise(bytes(data or b""), int(n))))
            yield pd.DataFrame(rows, columns=schema.names)

    read = rated.where("wanted").select(key, "page_number").join(files.select(key, content), key).select(key, "page_number", content).mapInPandas(work, schema)
    both = rated.join(read, [key, "page_number"], "left")
    return both.select(*pages.columns, "ocr_text", "confidence", Q.page_source(F.col("raw_text"), F.col("ocr_text"), F.col("garbled")).alias("source"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, the header after a byte-order mark."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, BOM + first).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def overwrite_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that rows has and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
