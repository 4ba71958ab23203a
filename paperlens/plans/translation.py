"""Queries over the enrichment run. Documents are the blocks (the first two languages as kinds), and a part of them seeds the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.functions import text as T
from paperlens.operators import translation as O
from paperlens.plans.registry import query
from paperlens.sources import scratch
from paperlens.sources import tables as S


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "paragraph").when(F.col("lang") == "de", "translation_prompt").when(F.col("lang") == "fr", "question").otherwise("heading")
    rows = S.documents(spark, d).select("doc_id", "source", "text", kind.alias("block_type"))
    return rows.withColumns({"style": O.style(F.col("block_type")), "text_hash": T.text_hash(F.col("text"))})


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    """Blocks without their texts, which are hashed once for all that a query does with them."""
    return scratch.once(_blocks(spark, d).select("doc_id", "block_type", "style", "text_hash"), "hashes")


def _cache(blocks: DataFrame) -> DataFrame:
    """Texts of every third document, under the legacy style for every sixth."""
    rows = blocks.where("doc_id % 3 = 0")
    style = F.when(F.col("doc_id") % 6 == 0, O.LEGACY_STYLE).otherwise(F.col("style"))
    return rows.select("text_hash", style.alias("style"), "doc_id").groupBy("text_hash", "style").agg(F.concat(F.lit("t"), F.min("doc_id").cast("string")).alias("translation"))


_B = """b AS (SELECT doc_id, source, text, CASE lang WHEN 'en' THEN 'paragraph' WHEN 'de' THEN 'translation_prompt' WHEN 'fr' THEN 'question' ELSE 'heading' END AS block_type,
 CASE lang WHEN 'de' THEN 'cet6_cn_to_en_reference' ELSE 'exam_intensive_zh' END AS style, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS text_hash FROM documents),
c AS (SELECT text_hash, CASE WHEN doc_id % 6 = 0 THEN 'exam_intensive' ELSE style END AS style, 't' || min(doc_id) AS translation FROM b WHERE doc_id % 3 = 0 GROUP BY ALL),
f AS (SELECT b.doc_id, b.text_hash, b.style, c.translation, c.style AS cached_style FROM b LEFT JOIN c ON c.text_hash = b.text_hash AND (c.style = b.style OR (b.style = 'exam_intensive_zh' AND c.style = 'exam_intensive'))
 QUALIFY row_number() OVER (PARTITION BY b.doc_id ORDER BY CASE WHEN c.style = b.style THEN 0 ELSE 1 END, c.translation) = 1)"""


@query(f"WITH {_B} SELECT doc_id FROM b WHERE block_type <> 'heading' AND length(trim(text)) >= 2")
def q_translatable(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).where(O.translatable(F.col("block_type"), F.col("text"))).select("doc_id")


@query(f"WITH {_B} SELECT style, count(*) AS n FROM b GROUP BY 1")
def q_style_route(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).groupBy("style").agg(F.count("*").alias("n"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    blocks = _hashed(spark, d)
    return O.lookup(blocks, _cache(blocks), ["doc_id"])


@query(f"WITH {_B} SELECT doc_id, style, translation, cached_style FROM f")
def q_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("doc_id", "style", "translation", "cached_style")


@query(f"WITH {_B} SELECT text_hash, style, count(*) AS blocks FROM f WHERE translation IS NULL GROUP BY ALL")
def q_cache_pending(spark: SparkSession, d: str) -> DataFrame:
    """Misses, once per hash and style."""
    return _found(spark, d).where("translation IS NULL").groupBy("text_hash", "style").agg(F.count("*").alias("blocks"))


@query(f"WITH {_B} SELECT doc_id, coalesce(translation, '') AS translation, translation IS NOT NULL AND translation <> 't' || doc_id AS needs_write FROM f")
def q_cache_apply(spark: SparkSession, d: str) -> DataFrame:
    old = F.concat(F.lit("t"), F.col("doc_id").cast("string"))
    return _found(spark, d).select("doc_id", F.coalesce("translation", F.lit("")).alias("translation"), (F.col("translation").isNotNull() & (F.col("translation") != old)).alias("needs_write"))


@query(f"WITH {_B}, n AS (SELECT DISTINCT text_hash, style, translation FROM f WHERE cached_style <> style) SELECT text_hash, style, max(translation) AS translation FROM (SELECT * FROM n UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.text_hash = c.text_hash AND n.style = c.style)) GROUP BY 1, 2")
def q_cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    blocks = _hashed(spark, d)
    cache = _cache(blocks)
    return O.migrated(cache, O.lookup(blocks, cache, ["doc_id"]))


PACKED_SQL = """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
    p AS (SELECT source, doc_id, r, 1 AS items, n_chars AS total, CAST(0 AS BIGINT) AS batch FROM o WHERE r = 1
    UNION ALL SELECT o.source, o.doc_id, o.r, CASE WHEN p.items >= 48 OR p.total + o.n_chars > 6500 THEN 1 ELSE p.items + 1 END, CASE WHEN p.items >= 48 OR p.total + o.n_chars > 6500 THEN o.n_chars ELSE p.total + o.n_chars END,
     p.batch + CASE WHEN p.items >= 48 OR p.total + o.n_chars > 6500 THEN 1 ELSE 0 END FROM p JOIN o ON o.source = p.source AND o.r = p.r + 1)
    SELECT source, doc_id, batch FROM p"""


@query(PACKED_SQL)
def q_batch_pack(spark: SparkSession, d: str) -> DataFrame:
    return O.packed(S.documents(spark, d).select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars").select("source", "doc_id", "batch")


@query(f"WITH {_B} SELECT style, doc_id FROM b WHERE style = 'exam_intensive_zh' UNION ALL SELECT style, doc_id FROM b WHERE style <> 'exam_intensive_zh'")
def q_union_batches(spark: SparkSession, d: str) -> DataFrame:
    blocks = _blocks(spark, d).select("style", "doc_id")
    return blocks.where(F.col("style") == O.STYLE).unionByName(blocks.where(F.col("style") != O.STYLE))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'no translation returned' END AS error FROM documents LEFT JOIN labels USING (doc_id)")
def q_translation_missing(spark: SparkSession, d: str) -> DataFrame:
    results = S.table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("t"))
    missing = F.nullif(F.col("t"), F.lit("")).isNull()
    return S.documents(spark, d).select("doc_id").join(results, "doc_id", "left").select("doc_id", F.when(missing, "no translation returned").alias("error"))


@query("SELECT doc_id, coalesce('q' || quality, lang) AS translation, CASE WHEN toxic = 1 THEN 'toxic' END AS error FROM documents LEFT JOIN labels USING (doc_id)")
def q_translation_apply(spark: SparkSession, d: str) -> DataFrame:
    blocks = S.documents(spark, d).select("doc_id", F.col("lang").alias("translation"))
    results = S.table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("translation"), F.when(F.col("toxic") == 1, "toxic").alias("error"))
    return O.patched(blocks, results, "doc_id").select("doc_id", "translation", "error")


@query(
    f"WITH {_B} SELECT source, count(*) AS total, count(*) FILTER (translation IS NOT NULL) AS cached, count(*) FILTER (translation IS NULL AND quality = 1) AS translated, count(*) FILTER (translation IS NULL AND coalesce(quality, 0) <> 1) AS failed FROM f JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY 1"
)
def q_translation_summary(spark: SparkSession, d: str) -> DataFrame:
    labels = S.table(spark, d, "labels").select("doc_id", "quality")
    rows = _found(spark, d).select("doc_id", "translation").join(S.documents(spark, d).select("doc_id", "source"), "doc_id").join(labels, "doc_id", "left")
    hit, ok = F.col("translation").isNotNull(), F.coalesce(F.col("quality") == 1, F.lit(False))
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(hit).alias("cached"), F.count_if(~hit & ok).alias("translated"), F.count_if(~hit & ~ok).alias("failed"))


@query(
    """WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)*'))) AS word FROM documents), c AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)*'))) AS word FROM benchmark)
    SELECT word, word IN (SELECT word FROM c) AS cached FROM w"""
)
def q_word_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words before any call, against a cache that holds the benchmark's words."""
    words = S.documents(spark, d).select(F.explode(T.words(F.col("text"))).alias("w")).select(F.lower("w").alias("word")).distinct()
    cache = S.table(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("w")).select(F.lower("w").alias("word")).distinct().withColumn("hit", F.lit(True))
    return words.join(cache, "word", "left").select("word", F.coalesce("hit", F.lit(False)).alias("cached"))


@query("SELECT conv_id AS paper_id, turn AS order_index, CASE WHEN quality = 0 THEN 'unknown' ELSE role END AS block_type FROM conversations LEFT JOIN labels ON doc_id = conv_id")
def q_type_override(spark: SparkSession, d: str) -> DataFrame:
    overrides = S.table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("paper_id"), F.lit("unknown").alias("override"))
    return S.blocks(spark, d).select("paper_id", "order_index", "block_type").join(overrides, "paper_id", "left").select("paper_id", "order_index", F.coalesce("override", "block_type").alias("block_type"))


def _batches(rows: DataFrame) -> DataFrame:
    """style, doc_id, text, route, batch of rows (style, doc_id, text, route). Keys and lengths alone are packed; texts join by key."""
    packed = O.packed(rows.select("doc_id", "route", F.char_length("text").alias("n")), "route", ["doc_id"], "n")
    return rows.select("style", "doc_id", "text").join(packed.select("doc_id", "route", "batch"), "doc_id")


class Reverser:
    """A stand-in provider without a network: the text backwards."""

    def translate(self, texts: dict[str, str], style: str) -> dict[str, str]:
        return {k: t[::-1] for k, t in texts.items()}


@query(f"WITH {_B} SELECT doc_id, sha256(reverse(text)) AS translation_hash FROM b WHERE block_type = 'question'")
def q_translate_run(spark: SparkSession, d: str) -> DataFrame:
    """The run over one kind of blocks: pack, call the provider, one request a batch."""
    rows = _blocks(spark, d).where("block_type = 'question'").select("style", "doc_id", "text", F.concat_ws("|", "style", "source").alias("route"))
    batches = _batches(rows)
    return O.translated(batches, Reverser(), "doc_id", "text").select("doc_id", F.sha2("translation", 256).alias("translation_hash"))


@query(f"WITH {_B} SELECT doc_id, b.style, translation IS NOT NULL AS cached, sha256(coalesce(translation, reverse(text))) AS translation_hash FROM f JOIN b USING (doc_id) WHERE block_type <> 'heading' AND length(trim(text)) >= 2")
def q_translate_all(spark: SparkSession, d: str) -> DataFrame:
    """The whole run: blocks that are translated meet the cache, misses of both styles are packed and sent."""
    blocks = scratch.once(_blocks(spark, d).select("doc_id", "style", "text_hash", O.translatable(F.col("block_type"), F.col("text")).alias("wanted")), "hashes")
    rows = O.lookup(blocks.where("wanted"), _cache(blocks), ["doc_id"])
    texts = S.documents(spark, d).select("doc_id", "source", "text")
    misses = rows.where("translation IS NULL").select("style", "doc_id").join(texts, "doc_id").select("style", "doc_id", "text", F.concat_ws("|", "style", "source").alias("route"))
    new = O.translated(_batches(misses), Reverser(), "doc_id", "text").join(rows.select("doc_id", "style"), "doc_id").select("doc_id", "style", F.lit(False).alias("cached"), "translation")
    both = rows.where("translation IS NOT NULL").select("doc_id", "style", F.lit(True).alias("cached"), "translation").unionByName(new)
    return both.select("doc_id", "style", "cached", F.sha2("translation", 256).alias("translation_hash"))


@query(
    f"""WITH {_B}, t AS (SELECT doc_id, text_hash, style, translation, cached_style, text FROM f JOIN b USING (doc_id, text_hash, style) WHERE block_type <> 'heading' AND length(trim(text)) >= 2),
    m AS (SELECT text_hash, style, coalesce(min(text) FILTER (doc_id % 2 = 0), min(text)) AS text, min(doc_id % 2) AS odd FROM t WHERE translation IS NULL GROUP BY 1, 2)
    SELECT run, doc_id, sha256(coalesce(translation, reverse(m.text))) AS translation_hash, run = 1 OR translation IS NOT NULL OR m.odd = 0 AND doc_id % 2 = 1 AS cached
    FROM t LEFT JOIN m USING (text_hash, style), (VALUES (0), (1)) r(run)"""
)
def q_translate_runs(spark: SparkSession, d: str) -> DataFrame:
    """Even documents, then odd ones, then all again: each missing hash is sent once, by the smallest of its run's texts, and what one run sent the next ones find in the cache."""
    blocks = scratch.once(_blocks(spark, d).where(O.translatable(F.col("block_type"), F.col("text"))).select("doc_id", "text_hash", "style", "text"), "blocks")
    run = O.Run(spark, scratch.folder(spark, "run"), Reverser(), "doc_id")
    run.seed(_cache(_hashed(spark, d)))
    for odd in (0, 1):
        run.run(blocks.where(F.col("doc_id") % 2 == odd), odd)
    first = scratch.once(run.results(), "first")
    counts = run.run(blocks, 2)
    if counts["calls"] or counts["cached"] != counts["total"]:
        raise ValueError(f"a second run over the same blocks sent some again: {counts}")
    again = spark.read.parquet(f"{run.path}/results/version=2")
    both = first.withColumn("run", F.lit(0)).unionByName(again.withColumn("run", F.lit(1)))
    return both.select("run", "doc_id", F.sha2("translation", 256).alias("translation_hash"), "cached")
