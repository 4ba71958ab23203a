"""Queries over what a reader sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.functions import text as T
from paperlens.operators import display as D
from paperlens.operators import grammar as G
from paperlens.operators import reading as V
from paperlens.operators import relational as R
from paperlens.operators.grammar import type_from_number
from paperlens.plans.registry import query
from paperlens.sources import tables as S

_RANK = "CASE WHEN l_partkey % 3 = 0 THEN 'question' ELSE 'option' END"


@query(
    f"""WITH b AS (SELECT l_orderkey AS p, l_linenumber AS q, {_RANK} AS kind, l_returnflag AS label, 't' || l_partkey AS text, (l_partkey, l_suppkey, l_extendedprice) AS o, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
    SELECT p AS paper_id, q AS question_number, arg_max(text, o) FILTER (kind = 'question') AS question, coalesce(string_agg(label || text, ',' ORDER BY label, l_partkey, l_suppkey, l_extendedprice) FILTER (kind = 'option'), '') AS options FROM b GROUP BY 1, 2"""
)
def q_question_groups(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("part") % 3 == 0, "question").otherwise("option")
    rows = S.items(spark, d).select("paper_id", F.col("order_index").alias("question_number"), kind.alias("kind"), F.col("flag").alias("label"), F.concat(F.lit("t"), F.col("part").cast("string")).alias("text"), "part", "source", "x")
    groups = V.question_groups(rows, ["paper_id", "question_number"], ["part", "source", "x"])
    return groups.select("paper_id", "question_number", "question", F.expr("array_join(transform(options, o -> concat(o.label, o.text)), ',')").alias("options"))


@query("SELECT o_orderkey AS paper_id, CASE WHEN min(l_linenumber) IS NULL THEN '无题号' ELSE min(l_linenumber) || '-' || max(l_linenumber) END AS range FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def q_question_range(spark: SparkSession, d: str) -> DataFrame:
    ranges = S.items(spark, d).groupBy("paper_id").agg(F.concat_ws("-", F.min("order_index").cast("string"), F.max("order_index").cast("string")).alias("range"))
    return S.papers(spark, d).select("paper_id").join(ranges, "paper_id", "left").select("paper_id", F.coalesce("range", F.lit("无题号")).alias("range"))


@query("SELECT conv_id AS paper_id, CASE WHEN min(turn) = max(turn) THEN 'P' || min(turn) ELSE 'P' || min(turn) || '-' || max(turn) END AS pages FROM conversations GROUP BY 1")
def q_page_range(spark: SparkSession, d: str) -> DataFrame:
    spans = S.blocks(spark, d).groupBy("paper_id").agg(F.min("order_index").alias("a"), F.max("order_index").alias("b"))
    return spans.select("paper_id", V.span(F.col("a"), F.col("b"), "P", "页码未知").alias("pages"))


@query("SELECT source, CASE WHEN d = n THEN '已翻译' WHEN d > 0 THEN d || '/' || n ELSE '待翻译' END AS progress FROM (SELECT source, count(quality) AS d, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)")
def q_section_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = S.documents(spark, d).select("doc_id", "source").join(S.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("quality").alias("d"), F.count("*").alias("n")).select("source", V.section_progress(F.col("d"), F.col("n")).alias("progress"))


_TITLES = ("Part I Writing", "Part II Listening", "Section A 选词填空", "Section  B on Matching", "Section C 仔细阅读", "Part IV Translation", "Section B 短文", "none")


_REPAIRED = """WITH e AS (SELECT conv_id, regexp_replace(list_extract(['Part I Writing', 'Part II Listening', 'Section A 选词填空', 'Section  B on Matching', 'Section C 仔细阅读', 'Part IV Translation', 'Section B 短文', 'none'], CAST(conv_id % 8 + 1 AS INTEGER)) || ' ' || string_agg(text, ' ' ORDER BY turn) FILTER (k <= 4), '\\s+', ' ', 'g') AS t,
      CASE WHEN conv_id % 3 > 0 THEN min(turn) + conv_id % 60 END AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY 1)
    SELECT conv_id AS paper_id, CASE WHEN regexp_matches(t, '(?i)Part\\s*I\\b.*Writing') THEN 'writing' WHEN regexp_matches(t, '(?i)Part\\s*II\\b.*Listening|Section\\s+[ABC]\\s*(长对话|短文|讲座)') THEN 'listening'
      WHEN regexp_matches(t, '(?i)Section\\s*A\\b.*(选词填空|word bank)') THEN 'reading_bank' WHEN regexp_matches(t, '(?i)Section\\s*B\\b.*(长篇匹配|matching)') THEN 'reading_matching' WHEN regexp_matches(t, '(?i)Section\\s*C\\b.*(仔细阅读|careful)') THEN 'reading_careful'
      WHEN regexp_matches(t, '(?i)Part\\s*IV\\b.*Translation') THEN 'translation' WHEN n IS NULL THEN 'own' WHEN n BETWEEN 1 AND 25 THEN 'listening' WHEN n BETWEEN 26 AND 35 THEN 'reading_bank' WHEN n BETWEEN 36 AND 45 THEN 'reading_matching' WHEN n BETWEEN 46 AND 55 THEN 'reading_careful' ELSE 'unknown' END AS type FROM e"""


@query(_REPAIRED)
def q_section_repair(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as sections with titles of their own: type by title and first four blocks, else by the smallest number, else as it was."""
    first = R.first_per(S.blocks(spark, d), ["paper_id"], [F.col("order_index")], 4)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "original_text"))), lambda x: x.original_text), " ")
    rows = first.groupBy("paper_id").agg(text.alias("t"), F.min("order_index").alias("n"))
    title = F.get(F.array(*map(F.lit, _TITLES)), (F.col("paper_id") % 8).cast("int"))
    number = F.when(F.col("paper_id") % 3 > 0, F.col("n") + F.col("paper_id") % 60)
    return rows.select("paper_id", V.type_by_evidence(F.concat_ws(" ", title, "t"), number, F.lit("own")).alias("type"))


@query(
    """WITH s AS (SELECT source, CASE WHEN doc_id % 8 = 0 THEN 'writing' WHEN doc_id % 8 = 1 THEN 'translation' WHEN doc_id % 60 BETWEEN 1 AND 25 THEN 'listening' WHEN doc_id % 60 BETWEEN 26 AND 55 THEN 'reading' ELSE 'unknown' END AS k FROM documents)
    SELECT source, CASE k WHEN 'writing' THEN 0 WHEN 'listening' THEN 1 WHEN 'reading' THEN 2 WHEN 'translation' THEN 3 ELSE 4 END AS place, CASE k WHEN 'writing' THEN '写作' WHEN 'listening' THEN '听力' WHEN 'reading' THEN '阅读' WHEN 'translation' THEN '翻译' ELSE '未分类' END AS label, count(*) AS n FROM s GROUP BY source, k"""
)
def q_directory_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sections of a source, in the five groups of the directory; empty groups are not shown."""
    n = F.col("doc_id")
    kind = F.when(n % 8 == 0, "writing").when(n % 8 == 1, "translation").otherwise(type_from_number(n % 60))
    return S.documents(spark, d).groupBy("source", V.directory_group(kind).alias("g")).agg(F.count("*").alias("n")).select("source", "g.place", "g.label", "n")


@query("SELECT p_brand, p_partkey, p_name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY ascii(upper(substr(p_name, 1, 1))) - 65, p_partkey) AS INTEGER) AS place FROM part")
def q_word_bank_sort(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    rank = V.label_rank(F.substring("p_name", 1, 1))
    return S.table(spark, d, "part").select("p_brand", "p_partkey", "p_name", F.row_number().over(Window.partitionBy("p_brand").orderBy(rank.asc_nulls_last(), "p_partkey")).alias("place"))


@query("SELECT conv_id AS paper_id, turn AS order_index, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, turn) AS INTEGER) AS place FROM conversations")
def q_section_layout(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    rank = F.when(F.col("block_type") == "system", 0).when(F.col("block_type") == "assistant", 1).otherwise(2)
    return S.blocks(spark, d).select("paper_id", "order_index", F.row_number().over(Window.partitionBy("paper_id").orderBy(rank, "order_index")).alias("place"))


@query("SELECT conv_id AS paper_id, turn AS order_index FROM conversations c WHERE role <> 'user' AND NOT EXISTS (SELECT 1 FROM conversations q WHERE q.conv_id = c.conv_id AND q.role = 'user' AND q.turn = c.turn - 1)")
def q_leading_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = S.blocks(spark, d).select("paper_id", "order_index", "block_type")
    asked = blocks.where("block_type = 'user'").select("paper_id", (F.col("order_index") + 1).alias("order_index"))
    return blocks.where("block_type <> 'user'").join(asked, ["paper_id", "order_index"], "left_anti").select("paper_id", "order_index")


@query("SELECT doc_id, w AS word FROM (SELECT doc_id, unnest(string_split('12. ' || text || ' 7', ' ')) AS w FROM documents) WHERE NOT regexp_matches(w, '^[0-9]{1,2}\\.?$')")
def q_display_filter(spark: SparkSession, d: str) -> DataFrame:
    """Each word as a block: bare question numbers are not shown."""
    words = S.documents(spark, d).select("doc_id", F.explode(F.split(F.concat(F.lit("12. "), F.col("text"), F.lit(" 7")), " ", -1)).alias("word"))
    return words.where(~V.is_noise(F.col("word")))


@query("SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN 'blocked' END, CASE WHEN quality = 1 THEN lang END, '待翻译') AS shown FROM documents LEFT JOIN labels USING (doc_id)")
def q_display_text(spark: SparkSession, d: str) -> DataFrame:
    rows = S.documents(spark, d).select("doc_id", "lang").join(S.table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", V.display_text(F.when(F.col("toxic") == 1, "blocked"), F.when(F.col("quality") == 1, F.col("lang"))).alias("shown"))


@query()
def q_reader_view(spark: SparkSession, d: str) -> DataFrame:
    """Sentence mode for long documents, whole paragraphs for the others."""
    rows = S.documents(spark, d).select("doc_id", "text", (F.char_length("text") > 620).alias("long"))
    parts = F.when(F.col("long"), T.sentences_en(F.col("text"))).otherwise(T.paragraphs(F.col("text")))
    return rows.select("doc_id", F.posexplode(parts).alias("pos", "shown"))


_V = """w AS (SELECT source, lower(x) AS word, doc_id AS met FROM (SELECT source, doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)*')) AS x FROM documents)),
v AS (SELECT source, word, count(*) AS count, max(met) AS last FROM w GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY max(met) DESC, word) <= 200)"""


def _cards(spark: SparkSession, d: str) -> DataFrame:
    words = S.documents(spark, d).select("source", F.col("doc_id").alias("at"), F.explode(T.words(F.col("text"))).alias("w"))
    return V.vocabulary(words.select("source", "at", F.lower("w").alias("word")), ["source"])


@query(f"WITH {_V} SELECT source, word, count, last, left(text, 5) AS context FROM v JOIN (SELECT doc_id AS last, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents) USING (last)")
def q_vocab_fold(spark: SparkSession, d: str) -> DataFrame:
    """Cards with the beginning of their context."""
    cards = V.with_context(_cards(spark, d), S.documents(spark, d).select(F.col("doc_id").alias("at"), "text"))
    return cards.select("source", "word", "count", "last", F.left("context", F.lit(5)).alias("context"))


@query(f"WITH {_V} SELECT source, count(*) AS cards, count(*) FILTER (count > 1) AS ready FROM v GROUP BY 1")
def q_vocab_summary(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d).groupBy("source").agg(F.count("*").alias("cards"), F.count_if(F.col("count") > 1).alias("ready"))


@query(f"""WITH {_V} SELECT source, '"' || word || '","' || count || '","' || last || '"' AS line FROM v""")
def q_vocab_csv(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d).select("source", V.csv_line(F.col("word"), F.col("count"), F.col("last")).alias("line"))


@query(f"WITH {_V} SELECT source, word, CAST(count AS INTEGER) AS count FROM v")
def q_vocab_load(spark: SparkSession, d: str) -> DataFrame:
    """Cards stored as one JSON array a reader, read back without cards that lack a word."""
    stored = _cards(spark, d).groupBy("source").agg(F.to_json(F.collect_list(F.struct("word", "count"))).alias("json"))
    cards = F.filter(F.from_json("json", "array<struct<word:string,count:int>>"), lambda c: F.coalesce(c.word, F.lit("")) != "")
    return stored.select("source", F.explode(F.slice(F.array_sort(cards), 1, V.CARDS)).alias("c")).select("source", "c.word", "c.count")


_TYPES = ("writing", "listening", "reading_bank", "reading_matching", "reading_careful", "translation", "unknown")
_KINDS = ("question", "option", "option", "paragraph", "word_bank", "translation_prompt", "heading", "passage")
_SHOWN = f"""b AS (SELECT conv_id AS paper_id, turn AS i, {list(_TYPES)}[conv_id % 7 + 1] AS type, {list(_KINDS)}[(turn + conv_id // 7) % 8 + 1] AS kind, CASE WHEN conv_id % 5 > 0 THEN (turn // 3)::INTEGER END AS number, chr(CAST(65 + (turn * 3) % 5 AS INTEGER)) AS label,
  CASE turn % 4 WHEN 0 THEN '(30 minutes) with' WHEN 1 THEN turn || '.' ELSE text END AS text, CASE (turn + conv_id) % 4 WHEN 1 THEN ' ' || text WHEN 2 THEN reverse(text) WHEN 3 THEN ' ' END AS zh, CASE WHEN conv_id % 11 = 0 AND turn % 2 = 1 THEN 'failed' END AS error FROM conversations),
l AS (SELECT *, CASE type WHEN 'listening' THEN 'questions' WHEN 'reading_careful' THEN 'questions' WHEN 'reading_bank' THEN 'bank' WHEN 'reading_matching' THEN 'matching' WHEN 'translation' THEN 'translation' ELSE 'general' END AS layout FROM b),
p AS (SELECT *, CASE layout WHEN 'questions' THEN CASE WHEN kind IN ('question', 'option') THEN 'card' ELSE 'lead' END WHEN 'bank' THEN CASE kind WHEN 'word_bank' THEN 'word bank' ELSE 'content' END
  WHEN 'matching' THEN CASE kind WHEN 'paragraph' THEN 'paragraphs' WHEN 'question' THEN 'questions' ELSE 'other' END WHEN 'translation' THEN CASE kind WHEN 'translation_prompt' THEN 'source' ELSE 'supporting' END ELSE 'blocks' END AS part,
  max(CASE kind WHEN 'question' THEN i END) OVER (PARTITION BY paper_id, number) AS asked FROM l),
v AS (SELECT *, part IN ('card', 'word bank', 'questions') AS small, coalesce(error, nullif(trim(coalesce(zh, '')), '')) AS raw, row_number() OVER (PARTITION BY paper_id ORDER BY CASE part WHEN 'lead' THEN 0 WHEN 'content' THEN 0 WHEN 'other' THEN 0 WHEN 'supporting' THEN 0 WHEN 'blocks' THEN 0 WHEN 'questions' THEN 2 ELSE 1 END,
  CASE part WHEN 'card' THEN number ELSE 0 END, CASE WHEN part = 'card' AND kind = 'question' THEN -1 WHEN part = 'card' THEN CASE WHEN label <= 'D' THEN ascii(label) - 65 ELSE 99 END WHEN part = 'word bank' THEN ascii(label) - 65 ELSE 0 END, i) AS place
  FROM p WHERE NOT (part = 'card' AND (number IS NULL OR kind = 'question' AND i < asked)) AND NOT (part = 'lead' AND kind = 'paragraph' AND text = '(30 minutes) with')),
m AS (SELECT *, coalesce(error, nullif(zh, ''), '待翻译') AS given, CASE part WHEN 'word bank' THEN mode <> 'hideChinese' ELSE mode IN ('parallel', 'sentence') END AS open_,
  trim(regexp_replace(coalesce(raw, ''), '\\s+', ' ', 'g')) <> trim(regexp_replace(text, '\\s+', ' ', 'g')) AS differs, mode IN ('parallel', 'sentence') AND NOT small AND kind <> 'heading' AND part <> 'source' AS pairs FROM v, (VALUES ('parallel'), ('sentence'), ('original'), ('hideChinese')) q(mode))"""


@query(
    f"""WITH {_SHOWN} SELECT paper_id, i AS order_index, mode, layout, part, CAST(place AS INTEGER) AS place,
    CASE WHEN small THEN 'small' WHEN part = 'source' THEN 'source and reference' WHEN kind = 'heading' THEN 'heading' WHEN mode = 'sentence' AND kind IN ('directions', 'passage', 'paragraph', 'translation_prompt') THEN 'pairs of sentences'
      WHEN pairs THEN 'pairs of paragraphs' WHEN mode = 'hideChinese' THEN 'paragraphs, translation hidden' ELSE 'paragraphs' END AS shape,
    coalesce(sha256(CASE WHEN small THEN CASE WHEN open_ AND (raw IS NOT NULL AND differs OR raw IS NULL AND NOT regexp_matches(text, '^[0-9]{{1,2}}\\.$')) THEN given END
      WHEN part = 'source' THEN coalesce(error, CASE WHEN trim(coalesce(zh, '')) <> '' THEN zh END, '待翻译/待生成参考译文') WHEN pairs THEN given END), '') AS beside FROM m"""
)
def q_reader_layout(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as sections of all types: what each mode shows, in which part and order, and what stands beside it."""
    turn, conv = F.col("order_index"), F.col("paper_id")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)
    text, state = F.col("original_text"), (turn + conv) % 4
    rows = S.blocks(spark, d).select(
        "paper_id", "order_index", pick(_TYPES, conv % 7).alias("section_type"), pick(_KINDS, (turn + F.floor(conv / 7)) % 8).alias("block_type"), F.when(conv % 5 > 0, F.floor(turn / 3).cast("int")).alias("question_number"),
        F.char((65 + turn * 3 % 5).cast("long")).alias("option_label"), F.when(turn % 4 == 0, "(30 minutes) with").when(turn % 4 == 1, F.concat(turn.cast("string"), F.lit("."))).otherwise(text).alias("original_text"),
        F.when(state == 1, F.concat(F.lit(" "), text)).when(state == 2, F.reverse(text)).when(state == 3, " ").alias("translated_text"), F.when((conv % 11 == 0) & (turn % 2 == 1), "failed").alias("translation_error"),
    )
    out = D.shown(D.arranged(rows, ["paper_id"]))
    return out.select("paper_id", "order_index", "mode", "layout", "part", "place", "shape", F.coalesce(F.sha2("beside", 256), F.lit("")).alias("beside"))


@query(f"WITH r AS ({_REPAIRED}), x AS (SELECT paper_id, {list(_TYPES)}[paper_id % 7 + 1] AS was, CASE type WHEN 'own' THEN {list(_TYPES)}[paper_id % 7 + 1] ELSE type END AS now FROM r) SELECT * FROM x WHERE was <> now")
def q_section_changes(spark: SparkSession, d: str) -> DataFrame:
    """Sections whose type a repair changes, and no others."""
    was = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("paper_id") % 7).cast("int") + 1)
    rows = q_section_repair(spark, d).withColumn("was", was)
    return rows.select("paper_id", "was", F.when(F.col("type") == "own", F.col("was")).otherwise(F.col("type")).alias("now")).where("was <> now")


@query(
    f"""SELECT conv_id AS paper_id, type, CASE type WHEN 'reading_bank' THEN '阅读 Section A 选词填空' WHEN 'reading_matching' THEN '阅读 Section B 长篇匹配' WHEN 'reading_careful' THEN '阅读 Section C 仔细阅读' WHEN 'writing' THEN '写作' WHEN 'listening' THEN '听力' WHEN 'translation' THEN '翻译' ELSE '未分类' END AS label,
    CASE type WHEN 'reading_bank' THEN '选词填空' WHEN 'reading_matching' THEN '长篇匹配' WHEN 'reading_careful' THEN '仔细阅读' WHEN 'writing' THEN '写作' WHEN 'listening' THEN '听力' WHEN 'translation' THEN '翻译' ELSE '未分类' END AS short,
    CAST(conv_id % 7 AS INTEGER) AS place, CASE type WHEN 'translation' THEN 'translation_prompt' WHEN 'reading_bank' THEN 'passage' WHEN 'reading_careful' THEN 'passage' ELSE 'paragraph' END AS plain_block
    FROM (SELECT DISTINCT conv_id, {list(_TYPES)}[conv_id % 7 + 1] AS type FROM conversations)"""
)
def q_section_types(spark: SparkSession, d: str) -> DataFrame:
    """Sections of all types: long and short label, place in the order of types, kind of their plain blocks."""
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("paper_id") % 7).cast("int") + 1)
    rows = S.blocks(spark, d).select("paper_id").distinct().withColumn("type", kind)
    return rows.select("paper_id", "type", V.label(F.col("type"), V.TYPE_LABELS, "").alias("label"), V.label(F.col("type"), G.TITLES, "").alias("short"), V.type_place(F.col("type")).alias("place"), G.default_block_type(F.col("type")).alias("plain_block"))
