"""A corpus pipeline: quality classifier, line dedup, near-dedup, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
docs, whatever these are called. run() writes each stage's result as Parquet in the shared folder and rereads it, and deletes
what the stage before wrote. An empty table, null texts and ids, and repeated rows pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.llm import decontamination, line_dedup, near_dedup, quality_classifier, sentencepiece_codec
from paperlens.llm.common import discard, small, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, does not reject."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; those of which nothing is left go."""
    found = line_dedup.without_repeats(docs)
    left = found.where((F.col("lines deleted") == 0) | (F.col("text") != ""))
    if "n_chars" not in docs.columns:
        return left.select(*(F.col(f"`{c}`") for c in docs.columns))
    length = F.when(F.col("lines deleted") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.select(*(length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more. Of rows with equal id and text
    one stays; a document without an id goes by its text, behind those with one. Ids may be of any type and length."""
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    repeated = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated").select(F.struct("key.*").alias("k"))
    same = F.expr("key.id <=> k.id AND key.h1 = k.h1 AND key.h2 = k.h2")
    once = rows.join(small(repeated), same, "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row", "key")
    rows = rows.join(small(repeated), same, "left_anti").union(once).withColumn("name", F.col("key.id"))
    if docs.where("doc_id IS NULL").limit(1).count():
        # Names for all: numbers in the order of the ids, so that the same ones stay as without nameless rows; those come last, by text.
        own = [F.col("key.id").alias("id"), *(F.when(F.col("key.id").isNull(), F.col(f"key.{h}")).alias(h) for h in ("h1", "h2"))]
        order = [F.col("id").asc_nulls_last(), "h1", "h2"]
        names = stored(rows.select(*own).distinct().orderBy(*order).select(F.struct("id", "h1", "h2").alias("of"), F.monotonically_increasing_id().alias("name")), "names")
        rows = rows.drop("name").withColumn("own", F.struct(*own)).join(names, F.expr("own.id <=> of.id AND own.h1 <=> of.h1 AND own.h2 <=> of.h2")).select("row", "key", "name")
    gone = near_dedup.near_duplicates(rows.select("name", "row.text"), k=5, percent=80, key="name").where(~F.col("kept")).select("name").distinct()
    return rows.join(small(stored(gone, "gone")), "name", "left_anti").select("row.*")


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts and digests of the ids and of the decoded text."""
    return sentencepiece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", fresh_lines),
    ("near-dedup", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("sentencepiece", encoded),
]

#: The classifier and the tokenizer cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs
