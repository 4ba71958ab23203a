"""Queries in Spark SQL alone, over the functions that register() gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlens.functions.sql import register
from paperlens.operators import grammar as G
from paperlens.operators import relational as R
from paperlens.plans import grammar, translation
from paperlens.plans.registry import query
from paperlens.sources import tables as S
from paperlens.sources.bucketed import bucketed


def _views(spark: SparkSession, d: str, *names: str) -> None:
    register(spark)
    for name in names:
        S.table(spark, d, name).createOrReplaceTempView(f"sql_{name}")


@query(translation.PACKED_SQL)
def q_sql_pack(spark: SparkSession, d: str) -> DataFrame:
    _views(spark, d, "documents")
    return spark.sql("SELECT grp AS source, ord AS doc_id, batch FROM pack_batches(TABLE(SELECT source AS grp, doc_id AS ord, n_chars AS size FROM sql_documents), 48, 6500)")


@query(
    f"""WITH {grammar._BLOCKS} SELECT paper_id, block_type, CAST(n + CASE WHEN block_type = 'paragraph' THEN matches ELSE 0 END AS BIGINT) AS n
    FROM (SELECT paper_id, block_type, count(*) AS n FROM b GROUP BY ALL) JOIN w USING (paper_id)"""
)
def q_sql_parse(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as the walk gives them, before paragraphs of matching sections join their questions."""
    register(spark)
    G.tagged(G.lines_of(grammar.exam_pages(spark, d))).createOrReplaceTempView("sql_lines")
    return spark.sql("SELECT paper_id, block_type, count(*) AS n FROM parse_paper(TABLE(sql_lines)) WHERE block_type IS NOT NULL GROUP BY ALL")


@query(
    """SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS hash, CASE WHEN doc_id % 60 BETWEEN 1 AND 25 THEN 'listening' WHEN doc_id % 60 BETWEEN 26 AND 35 THEN 'reading_bank'
    WHEN doc_id % 60 BETWEEN 36 AND 45 THEN 'reading_matching' WHEN doc_id % 60 BETWEEN 46 AND 55 THEN 'reading_careful' ELSE 'unknown' END AS type,
    CASE WHEN n_chars <= 0 THEN 0 ELSE least(100, CAST(round(doc_id / n_chars * 100) AS BIGINT)) END AS percent, CASE WHEN length(source || lang) <= 8 THEN '****' ELSE substr(source || lang, 1, 4) || '****' || right(source || lang, 4) END AS masked FROM documents"""
)
def q_sql_scalars(spark: SparkSession, d: str) -> DataFrame:
    _views(spark, d, "documents")
    return spark.sql("SELECT doc_id, exam_text_hash(text) AS hash, exam_section_type(cast(doc_id % 60 AS INT)) AS type, exam_percent(doc_id, n_chars) AS percent, exam_masked(source || lang) AS masked FROM sql_documents")


@query(
    """SELECT o_orderkey AS paper_id, coalesce(n, 0) AS n_items, coalesce(flags, '') AS flags FROM orders LEFT JOIN
    (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag, l_partkey) AS flags FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def q_library_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Papers with their items and counts from tables that lie together: no shuffle on either side."""
    papers, items = library(spark, d)
    counted = R.with_counts(R.nested(papers, items, "paper_id", ["order_index", "flag", "part"], ["flag"]), "paper_id", items=items)
    return counted.selectExpr("paper_id", "n_items", "coalesce(array_join(transform(children, c -> concat(c.order_index, c.flag)), ','), '') AS flags")


def library(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Papers and items as bucketed tables."""
    papers = bucketed(S.papers(spark, d).select("paper_id", "status"), "paper_id", [], "papers")
    return papers, bucketed(S.items(spark, d).select("paper_id", "order_index", "flag", "part"), "paper_id", ["order_index"], "items")

