"""Queries over scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.functions import quality as Q
from paperlens.functions import text as T
from paperlens.functions.jsregex import END, START, WS
from paperlens.plans.registry import SQL_SPACE, query, rewritten_sql
from paperlens.sources import tables as S

_S = SQL_SPACE
_COMPACT = rf"""trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"""


@query(f"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '{_S}+', ' ', 'g')))) AS text_hash FROM documents")
def q_text_hash(spark: SparkSession, d: str) -> DataFrame:
    return S.documents(spark, d).select("doc_id", T.text_hash(F.col("text")).alias("text_hash"))


@query(f"SELECT doc_id, {_COMPACT} AS compact FROM documents")
def q_compact_text(spark: SparkSession, d: str) -> DataFrame:
    return S.documents(spark, d).select("doc_id", T.compact(F.col("text")).alias("compact"))


_SENTENCES = """list_filter(list_transform(regexp_extract_all(trim(regexp_replace({}, '\\s+', ' ', 'g')), '[^.!?]+[.!?]+(?:["'')\\]]+)?|[^.!?]+$'), lambda x: trim(x)), lambda x: x <> '')"""


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents))")
def q_sentences_en(spark: SparkSession, d: str) -> DataFrame:
    return S.documents(spark, d).select("doc_id", F.posexplode(T.sentences_en(F.col("text"))).alias("pos", "sentence"))


_ZH = "translate(regexp_replace(text, '\\s+', '', 'g'), '.;?', '。；？')"


@query(f"SELECT doc_id, len(s) AS n, list_aggregate(list_transform(s, lambda x: length(x)), 'max') AS longest FROM (SELECT doc_id, regexp_extract_all({_ZH}, '[^。！？；]+[。！？；]+|[^。！？；]+$') AS s FROM documents)")
def q_sentences_zh(spark: SparkSession, d: str) -> DataFrame:
    """Document texts with CJK full stops."""
    s = T.sentences_zh(F.translate("text", ".;?", "。；？"))
    return S.documents(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", lambda x: F.char_length(x))).cast("long").alias("longest"))


@query(
    f"""SELECT doc_id, CASE WHEN c = '' THEN 0 WHEN len(b) > 1 THEN len(b) WHEN len(l) > 1 THEN len(l) ELSE 1 END AS n FROM (SELECT doc_id, c,
    list_filter(regexp_split_to_array(c, '\\n\\s*\\n'), lambda x: trim(x) <> '') AS b, list_filter(string_split(c, chr(10)), lambda x: length(trim(x)) >= 20) AS l FROM (SELECT doc_id, {_COMPACT} AS c FROM documents))"""
)
def q_explicit_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return S.documents(spark, d).select("doc_id", F.size(T.explicit_paragraphs(F.col("text"))).cast("long").alias("n"))


@query()
def q_paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    return S.documents(spark, d).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))


@query(
    """SELECT word, count(*) AS n, count(DISTINCT item_id) AS items FROM (SELECT item_id, regexp_replace(lower(unnest(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)*'))), '^[''-]+|[''-]+$', '', 'g') AS word FROM
    (SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - doc_id, text FROM documents)) GROUP BY 1"""
)
def q_words(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "benchmark").select("item_id", "text").union(S.documents(spark, d).select((-1 - F.col("doc_id")).alias("item_id"), "text"))
    words = rows.select("item_id", F.explode(T.words(F.col("text"))).alias("w")).select("item_id", T.lookup_word(F.col("w")).alias("word"))
    return words.groupBy("word", "item_id").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("items"))


_EXTRACTED = (
    ("\x00", ""), ("\r\n?", "\n"), (r"[ \t]+", " "), *((rf"([{T.CJK}]){WS}+([{T.CJK}，。；：？！、])", "$1$2"),) * 2, *((rf"([，。；：？！、]){WS}+([{T.CJK}])", "$1$2"),) * 2, (rf"{WS}+\n", "\n"), (r"\n{3,}", "\n\n"),
    *((f"(?i){START}{pattern.replace(chr(92) + 's', WS)}{END}", repair) for pattern, repair in T.BROKEN), (rf"\A{WS}+|{WS}+\z", ""),
)


@query(f"SELECT doc_id, {rewritten_sql('damaged', _EXTRACTED)} AS text FROM (SELECT doc_id, replace(text, ' the ', '  f our ') || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || 'Part 1V quest ions 一 二 ， 三' AS damaged FROM documents)")
def q_normalize_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Page texts with extraction damage put into them."""
    damaged = F.concat(F.regexp_replace("text", " the ", "  f our "), F.lit("\r\n\r\n\r\nPart 1V quest ions 一 二 ， 三"))
    return S.documents(spark, d).select("doc_id", T.normalize_extracted(damaged).alias("text"))


def quality_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.documents(spark, d).select("doc_id", "text", Q.quality(F.col("text")).alias("q"))


_COMMON = ", ".join(f"'{w}'" for w in Q.COMMON)
_QUALITY = f"""c AS (SELECT doc_id, text, regexp_replace(text, '{_S}+', '', 'g') AS c, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w FROM documents),
q AS (SELECT doc_id, text, length(c) AS n, greatest(length(c), 1) AS v, length(regexp_replace(c, '[^\\x{{3400}}-\\x{{9fff}}]', '', 'g')) AS cjk, length(regexp_replace(c, '[^�□■◆◇●]', '', 'g')) AS rep,
 length(regexp_replace(c, '[\\p{{L}}\\p{{N}}\\s.,;:!?''"()\\[\\]{{}}<>/@#$%&*+\\-=\\\\|_`~，。、《》？；：“”‘’（）【】—…·]', '', 'g')) AS abn, length(regexp_replace(c, '[^~?？]', '', 'g')) AS til, regexp_matches(c, '[~?？]{{6,}}') AS run,
 regexp_matches(text, '(?i)tOOA') OR regexp_matches(text, '[½¼¾¿¡]') AS moji, len(w) AS words, len(list_filter(w, lambda x: x IN ({_COMMON}))) AS common FROM c),
j AS (SELECT *, run OR (til >= 8 AND til / v > 0.12) AS dense, words >= 8 AND common / greatest(words, 1) >= 0.18 AS readable FROM q),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN rep / v > 0.04 THEN 'replacement-chars' END, CASE WHEN abn / v > 0.06 THEN 'abnormal-symbols' END, CASE WHEN dense THEN 'dense-question-tilde' END, CASE WHEN moji THEN 'known-mojibake' END,
 CASE WHEN n >= 120 AND cjk / v < 0.005 AND NOT readable AND abn / v > 0.035 THEN 'low-cjk-with-symbol-noise' END], lambda x: x IS NOT NULL), ',') AS reasons FROM j)"""


@query(f"WITH {_QUALITY} SELECT doc_id, CAST(n AS BIGINT) AS compact_length, round(abn / v, 6) AS abnormal_ratio, readable, reasons <> '' AS garbled, reasons FROM r")
def q_text_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality_rows(spark, d).select(
        "doc_id", F.col("q.compact_length").cast("long").alias("compact_length"), F.round("q.abnormal_ratio", 6).alias("abnormal_ratio"), "q.readable", "q.garbled", F.array_join("q.reasons", ",").alias("reasons")
    )


@query(f"""WITH {_QUALITY} SELECT doc_id, n < 80 OR reasons <> '' AS ocr, CASE WHEN NOT (n < 80 OR reasons <> '') THEN CASE WHEN n = 0 THEN 'EMPTY' ELSE 'PDF_TEXT' END WHEN n = 0 OR reasons <> '' THEN 'OCR' ELSE 'MIXED' END AS source FROM r""")
def q_ocr_route(spark: SparkSession, d: str) -> DataFrame:
    rows = quality_rows(spark, d).select("doc_id", "text", "q.garbled").withColumn("ocr", Q.wants_ocr(F.col("text"), F.col("garbled")))
    recognised = F.when(F.col("ocr"), F.lit("recognised")).otherwise("")
    return rows.select("doc_id", "ocr", Q.page_source(F.col("text"), recognised, F.col("garbled")).alias("source"))


@query(
    f"""WITH {_QUALITY} SELECT doc_id, coalesce(CASE WHEN (n = 0 OR reasons <> '') AND doc_id % 5 = 0 THEN 'OCR fallback failed on page ' || doc_id || ': down'
    WHEN (n = 0 OR reasons <> '') AND doc_id % 5 < 3 THEN 'OCR fallback returned no readable text on page ' || doc_id || CASE WHEN reasons <> '' THEN ' after ' || replace(reasons, ',', ', ') ELSE '' END END, '') AS error FROM r"""
)
def q_ocr_errors(spark: SparkSession, d: str) -> DataFrame:
    """Pages that neither their text nor OCR makes readable, with what is said of them."""
    rows = quality_rows(spark, d).select("doc_id", "text", "q.reasons")
    five = F.col("doc_id") % 5
    error = Q.ocr_error(F.col("doc_id"), F.col("text"), F.when(five >= 3, "read").otherwise(""), F.col("reasons"), F.when(five == 0, "down"))
    return rows.select("doc_id", F.coalesce(error, F.lit("")).alias("error"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN upper(lang) WHEN 1 THEN text || chr(10) || chr(10) || upper(lang) ELSE text END AS readable FROM documents")
def q_readable_text(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "OCR").when(F.col("doc_id") % 3 == 1, "MIXED").otherwise("PDF_TEXT")
    return S.documents(spark, d).select("doc_id", Q.readable_text(kind, F.col("text"), F.upper("lang")).alias("readable"))


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents)) WHERE trim(l[i]) <> ''")
def q_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = S.documents(spark, d).select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    return lines.where(F.regexp_replace("line", WS + "+", "") != "")


@query("SELECT doc_id, CASE WHEN contains(text, '-' || chr(10)) THEN replace(replace(text, '-' || chr(10), ''), chr(10), ' ') ELSE replace(text, chr(10), ' ') END AS joined FROM documents")
def q_join_lines(spark: SparkSession, d: str) -> DataFrame:
    from paperlens.operators.grammar import join_lines

    return S.documents(spark, d).select("doc_id", join_lines(F.split("text", "\n", -1)).alias("joined"))


class HtmlPages:
    """A stand-in extractor: the articles of an HTML file as pages, without their tags."""

    def pages(self, content: bytes):
        import re

        for article in re.findall(r"(?s)<article>(.*?)</article>", content.decode()):
            yield re.sub(r"<[^>]*>", "", article)


@query("SELECT page_id AS file_id, CAST(1 AS INTEGER) AS page_number, sha256(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', '', 'g')) AS hash FROM pages WHERE regexp_matches(html, '(?s)<article>.*</article>')")
def q_page_scan(spark: SparkSession, d: str) -> DataFrame:
    from paperlens.sources.files import extracted

    files = S.table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.col("html").cast("binary").alias("content"))
    return extracted(files, HtmlPages()).select("file_id", "page_number", F.sha2("raw_text", 256).alias("hash"))
