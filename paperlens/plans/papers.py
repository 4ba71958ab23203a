"""Queries over files: documents written as PDFs, read back by the file source, laid out, and taken in as papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.functions.jsregex import named
from paperlens.operators import ingest
from paperlens.plans.registry import query
from paperlens.sources import pdf, scratch
from paperlens.sources import tables as S

LINES = 40
#: Sub-folders that written files are dealt into, so that tasks can list them.
FOLDERS = 256


def _pages(docs: DataFrame):
    """Lines with a word, single blanks between words, LINES a page; a document without words is one empty page."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(F.regexp_replace(x, "[ \t\r]+", " "))), lambda x: x != "")
    starts = lambda ls: F.sequence(F.lit(0), F.greatest((F.size(ls) - 1) / LINES, F.lit(0)).cast("int"))
    # The lines are made once, not once a page.
    return docs.withColumn("pages", named(lines, lambda ls: F.transform(starts(ls), lambda i: F.slice(ls, i * LINES + 1, LINES))))


_LINES = "d AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents)"


@query(
    rf"""WITH {_LINES}, p AS (SELECT doc_id, ls, unnest(range(0, greatest((len(ls) - 1) // {LINES}, 0) + 1)) AS i FROM d)
    SELECT doc_id, CAST(i + 1 AS INTEGER) AS page_number, sha256(regexp_replace(regexp_replace(array_to_string(ls[i * {LINES} + 1:i * {LINES} + {LINES}], chr(10)), '([(\[{{]) ', '\1', 'g'), ' ([,.;:!?%)\]}}])', '\1', 'g')) AS hash FROM p"""
)
def q_pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document written as a PDF file, read back page by page and laid out by its items' places."""
    folder = scratch.folder(spark, "files")
    # However few row groups the table has, every core writes.
    docs = S.documents(spark, d).select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    pdf.write(_pages(docs.withColumn("text", F.coalesce("text", F.lit("")))).select(F.col("doc_id").cast("string").alias("name"), "pages"), folder, FOLDERS)
    texts = ingest.file_texts(spark, folder, split_bytes=1 << 20)
    return texts.select(F.regexp_extract("file", r"(-?[0-9]+)\.pdf", 1).cast("long").alias("doc_id"), "page_number", F.sha2("text", 256).alias("hash"))


@query(
    f"""WITH {_LINES}, e AS (SELECT ls, min(CAST(doc_id AS VARCHAR) || '.pdf') AS name FROM d WHERE doc_id % 2 = 0 GROUP BY 1),
    o AS (SELECT min(CAST(doc_id AS VARCHAR) || '.pdf') AS name FROM d WHERE doc_id % 2 = 1 AND ls NOT IN (SELECT ls FROM e) GROUP BY ls UNION SELECT CAST(doc_id AS VARCHAR) || '.pdf' FROM d WHERE doc_id % 10 = 3),
    t AS (SELECT name FROM e UNION ALL SELECT name FROM o)
    SELECT name, replace(name, '.pdf', '') AS title, 'UPLOADED' AS status, CAST(greatest((len(ls) - 1) // {LINES}, 0) + 1 AS BIGINT) AS n_pages FROM t JOIN d ON CAST(doc_id AS VARCHAR) || '.pdf' = name"""
)
def q_upload_papers(spark: SparkSession, d: str) -> DataFrame:
    """Two uploads of files into the table of papers: contents that it has already are left out, but for forced names."""
    folder = scratch.folder(spark, "uploads")
    docs = S.documents(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    for odd in (0, 1):
        files = docs.where(F.col("doc_id") % 2 == odd).repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
        pdf.write(_pages(files), f"{folder}/{odd}", FOLDERS)
        forced = docs.where("doc_id % 10 = 3").select(F.concat("name", F.lit(".pdf")).alias("name")) if odd else None
        ingest.ingested(spark, f"{folder}/{odd}", f"{folder}/papers", forced)
    pages = pdf.read(spark, folder, contents=False).groupBy(F.element_at(F.split("file", "/"), -1).alias("name")).agg(F.max("page_number").cast("long").alias("n_pages"))
    return ingest.papers(spark, f"{folder}/papers").join(pages, "name").select("name", "title", "status", "n_pages")
