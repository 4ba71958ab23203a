"""Queries over bilingual passages. Each user turn of a conversation is one language, the assistant's next turn the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.functions import text as T
from paperlens.operators import passages as P
from paperlens.plans.registry import query
from paperlens.sources import tables as S

STOPS = (".;?", "。；？")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    blocks = S.blocks(spark, d)
    en = blocks.where("block_type = 'user'").select("paper_id", "order_index", F.col("original_text").alias("en"))
    zh = blocks.where("block_type = 'assistant'").select("paper_id", (F.col("order_index") - 1).alias("order_index"), F.translate("original_text", *STOPS).alias("zh"))
    return en.join(zh, ["paper_id", "order_index"])


_EN = """list_filter(list_transform(regexp_extract_all(trim(regexp_replace(e.text, '\\s+', ' ', 'g')), '[^.!?]+[.!?]+(?:["'')\\]]+)?|[^.!?]+$'), lambda x: trim(x)), lambda x: x <> '')"""
_ZH = "regexp_extract_all(translate(regexp_replace(z.text, '\\s+', '', 'g'), '.;?', '。；？'), '[^。！？；]+[。！？；]+|[^。！？；]+$')"


@query(
    f"""WITH p AS (SELECT e.conv_id AS paper_id, e.turn AS order_index, {_EN} AS en, {_ZH} AS zh FROM conversations e JOIN conversations z ON z.conv_id = e.conv_id AND z.turn = e.turn + 1 WHERE e.role = 'user' AND z.role = 'assistant')
    SELECT paper_id, order_index, CAST(i - 1 AS INTEGER) AS pos, en[i] AS en, coalesce(zh[i], '') || CASE WHEN i = len(en) AND len(zh) > len(en) THEN array_to_string(zh[len(en) + 1:], '') ELSE '' END AS zh FROM (SELECT *, unnest(range(1, len(en) + 1)) AS i FROM p)"""
)
def q_sentence_align(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).select("paper_id", "order_index", T.sentences_en(F.col("en")).alias("en"), T.sentences_zh(F.col("zh")).alias("zh"))
    return rows.select("paper_id", "order_index", F.explode(P.sentence_pairs(F.col("en"), F.col("zh"))).alias("s")).select("paper_id", "order_index", F.col("s.order").alias("pos"), "s.en", "s.zh")


def _structures(spark: SparkSession, d: str) -> DataFrame:
    block_id = F.concat_ws("-", F.col("paper_id").cast("string"), F.col("order_index").cast("string"))
    return _pairs(spark, d).select("paper_id", "order_index", "en", "zh", block_id.alias("block_id"))


@query()
def q_paragraph_align(spark: SparkSession, d: str) -> DataFrame:
    rows = _structures(spark, d).select("paper_id", "order_index", F.explode(P.paragraph_structure(F.col("block_id"), F.col("en"), F.col("zh"))).alias("p"))
    return rows.select("paper_id", "order_index", F.col("p.id").alias("id"), F.col("p.order").alias("pos"), F.size("p.sentences").alias("n_sentences"), F.char_length("p.zh").alias("zh_chars"))


@query()
def q_passage_json(spark: SparkSession, d: str) -> DataFrame:
    return _structures(spark, d).select("paper_id", "order_index", F.to_json(P.passage(F.col("block_id"), F.col("en"), F.col("zh")), {"ignoreNullFields": "false"}).alias("json"))


@query()
def q_passage_parse(spark: SparkSession, d: str) -> DataFrame:
    """Passages as objects, as bare arrays, and broken ones, which are rebuilt."""
    full = F.to_json(P.passage(F.col("block_id"), F.col("en"), F.col("zh")))
    kind = F.col("paper_id") % 3
    rows = _structures(spark, d).withColumn("json", F.when(kind == 0, full).when(kind == 1, F.to_json(P.paragraph_structure(F.col("block_id"), F.col("en"), F.col("zh")))).otherwise("{broken"))
    back = P.parsed(F.col("json"), F.col("block_id"), F.col("en"), F.col("zh"))
    return rows.select("paper_id", "order_index", back.alias("p")).select("paper_id", "order_index", "p.id", F.size("p.paragraphs").alias("n_paragraphs"))
