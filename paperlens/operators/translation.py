"""The enrichment run: style routes, cache lookup by content hash, packing of misses, provider call, patch and summary."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from paperlens.functions.jsregex import trim
from paperlens.operators import packing
from paperlens.operators.relational import latest, upsert
from paperlens.sources.scratch import once

# Block types that are translated, styles, and the limits of a batch.
TRANSLATED = ("directions", "passage", "paragraph", "question_group", "question", "option", "word_bank", "translation_prompt")
PROMPT_STYLE, STYLE, LEGACY_STYLE = "cet6_cn_to_en_reference", "exam_intensive_zh", "exam_intensive"
BATCH_ITEMS, BATCH_CHARS, CONCURRENCY = 48, 6500, 6


class Translator(Protocol):
    """Turns texts of one style into translations; one call a batch. A missing id or an empty text counts as missing."""

    def translate(self, texts: dict[str, str], style: str) -> dict[str, str]: ...


def translatable(block_type: Column, text: Column, kinds: tuple[str, ...] = TRANSLATED) -> Column:
    return block_type.isin(*kinds) & (F.char_length(trim(text)) >= 2)


def style(block_type: Column, prompt: str = "translation_prompt") -> Column:
    return F.when(block_type == prompt, PROMPT_STYLE).otherwise(STYLE)


def lookup(blocks: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with translation and cached_style of the best cache row of their hash: their own style before the legacy one.

    The cache is ranked once per hash and wanted style before it meets the blocks, so a hash that many blocks share is ranked once.
    """
    wanted = blocks.select("text_hash", "style").distinct()
    found = wanted.join(cache.withColumnRenamed("style", "cached_style"), "text_hash").where((F.col("cached_style") == F.col("style")) | ((F.col("style") == STYLE) & (F.col("cached_style") == LEGACY_STYLE)))
    rank = F.when(F.col("cached_style") == F.col("style"), 0).otherwise(1)
    best = found.groupBy("text_hash", "style").agg(F.min_by(F.struct("translation", "cached_style"), F.struct(rank, "translation")).alias("hit"))
    return blocks.join(best, ["text_hash", "style"], "left").select(*keys, "text_hash", "style", "hit.translation", "hit.cached_style")


def packed(rows: DataFrame, group: str, order: list[str], size: str, most: int = BATCH_ITEMS, characters: int = BATCH_CHARS) -> DataFrame:
    """rows with a batch number: greedy, in order, closed at `most` items or before `characters` are passed; a longer item is alone."""
    return packing.packed(rows, group, order, size, most, characters)


def translated(batches: DataFrame, translator: Translator, key: str, text: str, concurrency: int = CONCURRENCY) -> DataFrame:
    """key, translation, error of every row; a failing batch stamps its own rows and no others. batches: style, batch, and route where batch
    numbers are those of a route. There are as many tasks as calls may be in flight; a task holds one batch at a time."""
    by = [c for c in ("style", "route", "batch") if c in batches.columns]
    schema = T.StructType([batches.schema[key], T.StructField("translation", T.StringType()), T.StructField("error", T.StringType())])

    def call(style: str, rows: list[tuple]) -> list[tuple]:
        try:
            found = translator.translate({str(k): t for k, t in rows}, style)
            return [(k, found.get(str(k)) or None, None if found.get(str(k)) else "missing") for k, _ in rows]
        except Exception as e:  # noqa: BLE001  a provider's failure becomes a column
            return [(k, None, f"{type(e).__name__}: {e}") for k, _ in rows]

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for f in frames for r in zip(*(c.to_pylist() for c in f.columns), strict=True))
        for at, batch in groupby(rows, key=lambda r: r[: len(by)]):
            done = call(at[0], [r[len(by) :] for r in batch])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], schema.names)

    kinds = [to_arrow_type(f.dataType) for f in schema]
    return batches.select(*by, key, text).repartition(concurrency, *by).sortWithinPartitions(*by).mapInArrow(work, schema)


def patched(blocks: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Blocks with new translations and errors where there are any."""
    return blocks.join(results.withColumnsRenamed({"translation": "_t", "error": "_e"}), key, "left").withColumns({"translation": F.coalesce("_t", "translation"), "error": F.col("_e")}).drop("_t", "_e")


def migrated(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """The cache with rows of the legacy style also under the style that asked for them."""
    new = hits.where("cached_style <> style").select("text_hash", "style", "translation").distinct().withColumn("version", F.lit(1))
    return upsert(cache.withColumn("version", F.lit(0)), new, ["text_hash", "style"], ["version", "translation"]).drop("version")


class Run:
    """Enrichment of blocks against a cache that is a table of versions in a folder; each run adds one.

    run() takes blocks (key, text_hash, style, text), looks them up, sends each missing hash once, in batches, and writes two folders of its version:
    new cache rows (answers, and rows of the legacy style under the style that asked for them) and results (key, translation,
    cached, error). A version that runs again finds the cache of the versions before it and overwrites its own folders. Counters are
    taken while results and batches are written; nothing is read a second time for them."""

    def __init__(self, spark: SparkSession, path: str, translator: Translator, key: str, route: str = "style"):
        self.spark, self.path, self.translator, self.key, self.route = spark, path, translator, key, route

    def cache(self, before: int | None = None) -> DataFrame:
        """text_hash, style, translation: of each the last version (before one, if named)."""
        rows = self.spark.read.schema("text_hash string, style string, translation string, version long").parquet(f"{self.path}/cache")
        rows = rows if before is None else rows.where(F.col("version") < before)
        return latest(rows, ["text_hash", "style"], ["version", "translation"]).drop("version")

    def seed(self, rows: DataFrame) -> None:
        """Cache rows from elsewhere, as the version before the first run."""
        self._write(rows.select("text_hash", "style", "translation"), "cache", -1)

    def results(self) -> DataFrame:
        """key, translation, cached, error of all runs."""
        return self.spark.read.parquet(f"{self.path}/results").drop("version")

    def _write(self, rows: DataFrame, table: str, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/version={version}")

    def run(self, blocks: DataFrame, version: int) -> dict[str, int]:
        """total, cached, translated, failed, batches, calls (rows sent) of this version."""
        rows = once(lookup(blocks, self.cache(version), [self.key]), "looked-up")
        missing = rows.where("translation IS NULL").drop("translation", "cached_style")
        # Texts meet the missing hashes and are reduced to one a hash in one and the same exchange.
        texts = blocks.join(missing.select("text_hash", "style").distinct(), ["text_hash", "style"], "left_semi").groupBy("text_hash", "style").agg(F.min("text").alias("text"))
        texts = once(texts.withColumn("route", F.col(self.route)), "pending")
        first = F.row_number().over(Window.partitionBy("style", "route", "batch").orderBy("text_hash")) == 1
        numbers = packed(texts.select("text_hash", "style", "route", F.char_length("text").alias("n")), "route", ["text_hash"], "n").drop("n").withColumn("first", first)
        sent, seen = Observation("sent"), Observation("seen")
        batches = texts.join(numbers, ["text_hash", "style", "route"]).observe(sent, F.count("*").alias("calls"), F.count_if("first").alias("batches"))
        answers = once(translated(batches.withColumn("id", F.concat_ws("|", "text_hash", "style")), self.translator, "id", "text"), "answers")
        named = answers.select(F.substring_index("id", "|", 1).alias("text_hash"), F.substring_index("id", "|", -1).alias("style"), F.col("translation").alias("answer"), "error")
        old = rows.where("cached_style <> style").select("text_hash", "style", "translation").distinct()
        self._write(named.where("answer IS NOT NULL").select("text_hash", "style", F.col("answer").alias("translation")).unionByName(old), "cache", version)
        # What the cache had goes out as it is; only rows without a translation meet the answers.
        hits = rows.where("translation IS NOT NULL").select(self.key, "translation", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error"))
        done = hits.unionByName(missing.join(named, ["text_hash", "style"], "left").select(self.key, F.col("answer").alias("translation"), F.lit(False).alias("cached"), "error"))
        counts = [F.count("*").alias("total"), F.count_if(F.col("cached")).alias("cached"), F.count_if(~F.col("cached") & F.col("translation").isNotNull()).alias("translated"), F.count_if(F.col("translation").isNull()).alias("failed")]
        self._write(done.observe(seen, *counts), "results", version)
        return seen.get | sent.get

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Run a stream of blocks, each batch as the version of its number; a batch that is repeated gives the same version again."""
        stream.writeStream.foreachBatch(lambda batch, number: self.run(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
