"""The driver's tables, and views of them as the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("priority"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of a paper; the key is not unique, so orders need the further columns."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("order_index"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("source"), F.col("l_quantity").alias("height"),
        F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as blocks of a paper."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("order_index"), F.col("role").alias("block_type"), F.col("text").alias("original_text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of job states: stage by event type."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("paper_id"), "event_id", "ts", F.col("event_type").alias("stage"), F.col("value").alias("progress"), "props",
    )
