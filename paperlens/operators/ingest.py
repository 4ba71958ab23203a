"""Papers from files: each file's hash and name, one paper for files of one content, pages by the file source, rows appended to tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlens.operators import layout
from paperlens.sources import listing, pdf
from paperlens.sources.scratch import once

#: Bytes of an upload that are read at once.
PIECE = 1 << 20

PAPERS = T.StructType([T.StructField(n, T.LongType() if n == "n_bytes" else T.StringType()) for n in ("name", "title", "file_hash", "n_bytes", "status")])


def uploaded(spark: SparkSession, path: str) -> DataFrame:
    """name, title, file_hash, n_bytes of the PDF files in a folder and its sub-folders, but for hidden ones (_ or . before a name). Tasks list
    the files and hash their bytes piece by piece; the driver holds none of their names."""
    schema = "file string, file_hash string, n_bytes long"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = listing.place(path)
        for batch in batches:
            hashes, sizes = [], []
            for file in batch["file"].to_pylist():
                found, size = hashlib.sha256(), 0
                with store.open_input_stream(f"{base}/{file}") as content:
                    while piece := content.read(PIECE):
                        found.update(piece)
                        size += len(piece)
                hashes.append(found.hexdigest())
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch["file"], pa.array(hashes, pa.string()), pa.array(sizes, pa.int64())], names=["file", "file_hash", "n_bytes"])

    shown = listing.pdfs(spark, path).where(~F.col("file").rlike(r"(^|/)[_.]")).select("file")
    files = shown.repartition(listing.tasks(spark)).mapInArrow(hashed, schema)
    name = F.element_at(F.split("file", "/"), -1)
    return files.select(name.alias("name"), F.regexp_replace(name, r"(?i)\.pdf\z", "").alias("title"), "file_hash", "n_bytes")


def papers(spark: SparkSession, table: str) -> DataFrame:
    """The table of papers; empty before the first is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(table)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(PAPERS).parquet(table) if there else spark.createDataFrame([], PAPERS)


def taken(files: DataFrame, known: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Of the files those that become papers: the first name of each content that no paper of the table has, failed ones not
    counted, and those whose name is forced. Only hashes and names meet."""
    files = files.dropDuplicates(["name", "file_hash"])  # of several sub-folders
    hashes = known.where("status <> 'FAILED'").select("file_hash").distinct()
    wanted = files.join(hashes, "file_hash", "left_anti").groupBy("file_hash").agg(F.min("name").alias("name")).select("name", "file_hash")
    if forced is not None:
        wanted = wanted.union(files.join(forced.select("name"), "name", "left_semi").select("name", "file_hash")).distinct()
    return files.join(wanted, ["name", "file_hash"], "left_semi")


def ingested(spark: SparkSession, path: str, table: str, forced: DataFrame | None = None) -> None:
    """Append the papers of a folder's new files to the table."""
    # Files are read and hashed once, though hashes and names are used twice.
    new = taken(once(uploaded(spark, path), "uploads"), papers(spark, table), forced)
    new.select("name", "title", "file_hash", "n_bytes", F.lit("UPLOADED").alias("status")).write.mode("append").parquet(table)


def positioned(items: DataFrame) -> DataFrame:
    """Rows of the file source as rows of the page layout: file, page_number, idx (null: no item), text, x, y, width, height, error."""
    at = lambda i: layout.finite(F.get("transform", F.lit(i)))
    return items.select("file", "page_number", "idx", F.col("str").alias("text"), at(4).alias("x"), at(5).alias("y"), layout.finite(F.col("width")).alias("width"), layout.finite(F.col("height")).alias("height"), "error")


def page_texts(items: DataFrame) -> DataFrame:
    """file, page_number, text, error of every page; pages without text have an empty one. The items are read once."""
    texts = layout.page_texts(positioned(items), ["file", "page_number"], error=F.first("error", ignorenulls=True))
    return texts.select("file", "page_number", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")


def _laid_out(pages: pa.RecordBatch) -> pa.RecordBatch:
    text = layout.texts(*(pages[c] for c in ("str", "x", "y", "width", "height")))
    return pa.RecordBatch.from_arrays([pages["file"], pages["page_number"], pc.if_else(pages["error"].is_null(), text, None), pages["error"]], names=["file", "page_number", "text", "error"])


def file_texts(spark: SparkSession, path: str, split_bytes: int = pdf.SPLIT_BYTES) -> DataFrame:
    """What page_texts gives for the PDF files below a folder. A task lays out the pages that it reads, so no item crosses an exchange."""
    return pdf.pages(spark, path, split_bytes, _laid_out, "file string, page_number int, text string, error string")
