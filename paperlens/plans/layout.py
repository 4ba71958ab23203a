"""Queries over page layout. Line items are the text items of a page (their order): part and quantity give place and size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlens.operators import layout as L
from paperlens.plans.registry import query
from paperlens.sources import tables as S

PAGE = ["page"]


def text_items(spark: SparkSession, d: str) -> DataFrame:
    rows = S.items(spark, d).select(
        F.col("paper_id").alias("page"), (F.col("part") % 500).cast("double").alias("x"), (F.col("source") * 7 % 700).cast("double").alias("y"), F.col("height"), F.concat(F.lit("w"), F.col("part").cast("string")).alias("text"), "order_index", "part", "source", F.col("x").alias("price"),
    )
    order = Window.partitionBy("page").orderBy("order_index", "part", "source", "price")
    return rows.select("page", F.row_number().over(order).alias("idx"), "text", "x", "y", (F.char_length("text") * 5.0).alias("width"), "height")


_I = """i AS (SELECT l_orderkey AS page, CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y, l_quantity AS height, 'w' || l_partkey AS text, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS idx FROM lineitem)"""


@query(f"WITH {_I} SELECT page, idx, text, x, y, height FROM i")
def q_text_item_scan(spark: SparkSession, d: str) -> DataFrame:
    """Items written as JSON and read back."""
    rows = text_items(spark, d)
    json = F.to_json(F.struct(F.col("text").alias("str"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.col("height"), F.col("x"), F.col("y")).alias("transform"), "width", F.lit(0.0).alias("height")))
    return rows.select("page", "idx", L.items_from_json(json).alias("i")).select("page", "idx", "i.text", "i.x", "i.y", "i.height")


@query(f"WITH {_I} SELECT page, idx, CAST(row_number() OVER (PARTITION BY page ORDER BY y DESC, x, idx) AS INTEGER) AS place FROM i")
def q_item_sort(spark: SparkSession, d: str) -> DataFrame:
    return text_items(spark, d).select("page", "idx", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("y"), "x", "idx")).alias("place"))


@query(f"WITH {_I} SELECT page, round(greatest(2.0, 0.65 * quantile_cont(height, 0.5)), 6) AS tolerance FROM i WHERE height > 0 GROUP BY 1")
def q_layout_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return L.tolerance(text_items(spark, d), PAGE).select("page", F.round("tolerance", 6).alias("tolerance"))


@query(
    f"""WITH {_I}, g AS (SELECT *, lead(x) OVER w AS nx, row_number() OVER w AS r, count(*) OVER (PARTITION BY page) AS n, max(x) OVER (PARTITION BY page) - min(x) OVER (PARTITION BY page) AS rg FROM i WINDOW w AS (PARTITION BY page ORDER BY x, idx)),
    b AS (SELECT page, n, rg, x, nx, r FROM g QUALIFY row_number() OVER (PARTITION BY page ORDER BY coalesce(nx - x, -1) DESC, r) = 1),
    s AS (SELECT page, CASE WHEN n >= 4 AND r >= 2 AND n - r >= 2 AND nx - x >= greatest(48, 0.18 * greatest(rg, 1)) THEN (x + nx) / 2 END AS split FROM b)
    SELECT page, idx, CASE WHEN x >= split THEN 1 ELSE 0 END AS column FROM i JOIN s USING (page)"""
)
def q_layout_columns(spark: SparkSession, d: str) -> DataFrame:
    """Every item as a line of its own."""
    return L.columns_of(text_items(spark, d).withColumn("order", F.col("idx")), PAGE).select("page", "idx", "column")


@query(
    f"""WITH {_I}, b AS (SELECT *, length(text) * 5.0 AS w, lag(x) OVER o AS bx, lag(length(text) * 5.0) OVER o AS bw, lag(length(text)) OVER o AS bn FROM i WINDOW o AS (PARTITION BY page ORDER BY x, y DESC, idx))
    SELECT page, string_agg(CASE WHEN x - (bx + bw) > 0 AND x - (bx + bw) > greatest(1.5, 0.45 * (w / length(text) + bw / bn) / 2) THEN ' ' ELSE '' END || text, '' ORDER BY x, y DESC, idx) AS text FROM b GROUP BY 1"""
)
def q_line_text(spark: SparkSession, d: str) -> DataFrame:
    """All items of a page as one line."""
    return L.joined_line(text_items(spark, d), PAGE).select("page", "text")


@query()
def q_layout_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.clustered(text_items(spark, d), PAGE).select("page", "idx", "line")


@query()
def q_reading_order(spark: SparkSession, d: str) -> DataFrame:
    items = text_items(spark, d)
    lines = L.columns_of(items.select("page", F.col("idx").alias("line"), F.col("idx").alias("order"), "x", "y", "text"), PAGE)
    return L.ordered_lines(lines, PAGE).select("page", "line", "place")


@query()
def q_page_text(spark: SparkSession, d: str) -> DataFrame:
    return L.page_texts(text_items(spark, d), PAGE)
