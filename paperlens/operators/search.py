"""Search for any text inside blocks by an index of trigrams.

build() writes two tables. Blocks: numbered, in segments (one a task), with their folded texts. Postings: for each folding and gram, in
buckets of the gram's hash, the numbers of the blocks that hold it; a list is cut at every SHARD numbers and holds their distances from
the shard's first, so that no row grows with the table and a number takes two bytes. found() takes the rarest grams of a needle (by the lists' own counts), intersects their lists shard by shard,
and verifies the blocks that are left, in the segments that have any. A needle of fewer than three characters has no gram and is looked for in all
blocks. The server folds A-Z alone, the reader all letters: each has an index of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.functions.jsregex import trim

#: Numbers of a posting list's shard, buckets of grams, and how many of a needle's grams are intersected.
SHARD, BUCKETS, GRAMS = 1 << 16, 64, 4
#: Blocks to verify up to which their numbers are broadcast.
BROADCAST_ROWS = 100_000
FOLDS = {
    "ascii": lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
    "lower": F.lower,
}


def grams(text: Column) -> Column:
    """All runs of three characters, once each; one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))"), F.lit(1)))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(blocks: DataFrame, texts: list[str], path: str, folds: tuple[str, ...] = tuple(FOLDS)) -> None:
    """Write the index of blocks (texts: names of the columns that are searched; others come back with a hit), for the foldings that will be asked for."""
    spark = blocks.sparkSession
    number = F.monotonically_increasing_id()
    numbered = blocks.withColumn("number", number).withColumn("segment", F.shiftright("number", 33).cast("int"))
    numbered.write.mode("overwrite").partitionBy("segment").parquet(f"{path}/blocks")
    kept = spark.read.parquet(f"{path}/blocks")
    parts = []
    for fold in folds:
        own = reduce(F.array_union, (grams(FOLDS[fold](F.coalesce(c, F.lit("")))) for c in texts))
        parts.append(kept.select(F.lit(fold).alias("fold"), "number", F.explode(own).alias("gram")))
    rows = reduce(DataFrame.union, parts).withColumn("shard", F.floor(F.col("number") / SHARD))
    offset = (F.col("number") % SHARD).cast("int")
    lists = rows.groupBy("fold", "gram", "shard").agg(F.sort_array(F.collect_list(offset)).alias("offsets"))
    coded = lists.select("fold", "gram", "shard", "offsets", F.size("offsets").alias("n"), _bucket(F.col("gram")).alias("bucket"))
    coded.repartition("fold", "bucket").sortWithinPartitions("gram", "shard").write.mode("overwrite").partitionBy("fold", "bucket").parquet(f"{path}/postings")


def postings(spark: SparkSession, path: str, fold: str, wanted: list[str]) -> DataFrame:
    """gram, shard, offsets, n of these grams: only their buckets are read, and there only row groups that can hold them."""
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
    table = spark.read.schema("gram string, shard long, offsets array<int>, n int, fold string, bucket int").parquet(f"{path}/postings")
    return table.where((F.col("fold") == fold) & F.col("bucket").isin(buckets) & F.col("gram").isin(wanted)).drop("fold", "bucket")


def candidates(spark: SparkSession, path: str, fold: str, needle: str) -> DataFrame:
    """Numbers of the blocks that hold the rarest grams of a needle (folded, three characters or more)."""
    wanted = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
    counts = {r.gram: r.n for r in postings(spark, path, fold, wanted).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row a gram of the needle
    if len(counts) < len(wanted):
        return spark.createDataFrame([], "number long")
    rarest = sorted(wanted, key=lambda g: (counts[g], g))[:GRAMS]
    lists = postings(spark, path, fold, rarest).groupBy("shard").agg(F.collect_list("offsets").alias("lists")).where(F.size("lists") == len(rarest))
    common = F.expr("aggregate(slice(lists, 2, size(lists)), lists[0], (a, x) -> array_intersect(a, x))")
    return lists.select("shard", F.explode(common).alias("offset")).select((F.col("shard") * SHARD + F.col("offset")).alias("number"))


def found(spark: SparkSession, path: str, fold: str, query: str, texts: list[str], numbers: dict[str, str] | None = None, within: Column | None = None) -> DataFrame:
    """Blocks in which one of the texts contains the query (trimmed and folded), or of which a number is it. numbers: columns, and how
    these are compared: as "integer" or as "text". within: a condition that all must meet. An empty query finds all blocks."""
    needle = spark.range(1).select(FOLDS[fold](trim(F.lit(query)))).first()[0]
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks = blocks.where(within) if within is not None else blocks
    if not needle:
        return blocks.drop("number", "segment")
    holds = reduce(Column.__or__, (F.coalesce(F.contains(FOLDS[fold](F.col(c)), F.lit(needle)), F.lit(False)) for c in texts))
    same = F.lit(False)
    for c, how in (numbers or {}).items():
        text = F.col(c).cast("string") == needle
        same = same | F.coalesce((F.col(c) == F.lit(needle).try_cast("decimal(38,9)")) if how == "integer" else text, F.lit(False))
    if len(needle) < 3:
        return blocks.where(holds | same).drop("number", "segment")
    own = candidates(spark, path, fold, needle).select("number", F.shiftright("number", 33).cast("int").alias("segment"))
    few = len(own.limit(BROADCAST_ROWS + 1).select(F.lit(1)).collect()) <= BROADCAST_ROWS
    hits = blocks.join(F.broadcast(own) if few else own, ["segment", "number"], "left_semi").where(holds)
    return hits.unionByName(blocks.where(same & ~holds)).drop("number", "segment") if numbers else hits.drop("number", "segment")

