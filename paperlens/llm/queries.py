"""Registered queries of the operators in this subpackage, with the SQL for those that SQL can express."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from paperlens.llm import chat_format, decontamination, license_scan, line_dedup, near_dedup, quality_classifier, quality_rules, ranked_search, sentencepiece_codec, token_counts, url_filters, vector_codes, warc
from paperlens.llm.common import stored, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), least=0)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), policy="v1")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), within=True)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted, text (what is left) of every document."""
    found = line_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.selectExpr("doc_id", "`lines before` AS n_lines", "`lines deleted` AS n_deleted", "text")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return chat_format.read_back(chat_format.formatted(rows.union(more), path), path)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each rule of the policy: documents that fail it, that fail it alone, and that stay without it, from a stored ledger."""
    return quality_rules.ablations(stored(quality_rules.ledger(table(spark, sf_dir, "documents")), "ledger"), "v1")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_url_filters, op3_quality_classifier, op4_decontamination, op5_warc, op6_near_dedup, op7_token_counts, op8_quality_rules, op9_license_scan, op10_line_dedup, op11_ranked_search, op12_chat_format, op13_vector_codes, quality_ablations, pipeline,
    )
}

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '{_WORDS}') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_WORDS}') AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM sized)),
lengths AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM d, lengths)),
hit AS (SELECT r, k, n, item_id FROM dw JOIN iw USING (n, g)),
covered AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM (SELECT r, k, unnest(range(0, n)) AS o FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""

_OP5 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT sha1(b) AS s, octet_length(b) AS n, min(page_id) AS first FROM p GROUP BY ALL),
digits AS (SELECT page_id, octet_length(b) AS payload_bytes, first, list_transform(range(0, 32), lambda k: ('0x' || substr(sha1(b) || '0', 1, 40))) AS unused, sha1(b) AS hex FROM p JOIN f ON sha1(b) = s AND octet_length(b) = n),
bits AS (SELECT page_id, payload_bytes, first, list_transform(range(0, 32), lambda k: CAST(('0x' || substr(hex, CAST(1 + (k * 5) // 4 AS BIGINT), 2) || CASE WHEN 1 + (k * 5) // 4 = 40 THEN '0' ELSE '' END) AS BIGINT) // CAST(pow(2, 3 - (k * 5) % 4) AS BIGINT) % 32) AS v FROM digits)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits"""

_OP8_FAILURES = """
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM (SELECT r, i, unnest(range(0, 8)) AS o FROM again) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaiming
  FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN n_repeat_words > 0.3 * n_words THEN 2 ELSE 0 END + CASE WHEN n_symbols > 0.3 * n_words THEN 4 ELSE 0 END
  + CASE WHEN n_words > 0 AND (word_chars / n_words < 2 OR word_chars / n_words > 20) THEN 8 ELSE 0 END + CASE WHEN n_lines > 0 AND 3 * n_dup_lines > 2 * n_lines THEN 16 ELSE 0 END
  + CASE WHEN n_upper + n_upper > word_chars THEN 32 ELSE 0 END + CASE WHEN n_exclaiming > 0.2 * n_words THEN 64 ELSE 0 END AS failures FROM m)"""

_OP8 = f"""WITH {_OP8_FAILURES}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failures % 4 > 0 AS base_failed, failures = 0 AS kept, CAST(failures AS BIGINT) AS failures FROM f"""

_ABLATIONS = f"""WITH {_OP8_FAILURES},
rules(rule, bit) AS (VALUES ('too_few_words', 1), ('repeated_windows', 2), ('many_symbols', 4), ('odd_word_length', 8), ('repeated_lines', 16), ('shouting', 32), ('exclaiming', 64))
SELECT rule, count(*) FILTER (failures // bit % 2 = 1) AS fail, count(*) FILTER (failures = bit) AS fail_alone, count(*) FILTER (failures IN (0, bit)) AS kept_without FROM rules, f GROUP BY rule"""

_TEMPLATES = ", ".join("('{}', {}, '{}')".format(b.replace("'", "''"), len(bigrams), name) for name, bigrams in license_scan.template_bigrams().items() for b in bigrams)
_OP9 = f"""
WITH t(bigram, t_size, template) AS (VALUES {_TEMPLATES}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
u AS (SELECT r, 'line' AS kind, i, string_split(x, chr(10))[i] AS u FROM (SELECT r, x, unnest(range(1, len(string_split(x, chr(10))) + 1)) AS i FROM d)
  UNION ALL SELECT r, 'paragraph', i, p[i] FROM (SELECT r, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT r, regexp_split_to_array(x, '\n[ \t\r]*\n') AS p FROM d) WHERE len(p) > 1) WHERE contains(p[i], chr(10))
  UNION ALL SELECT r, 'text', 0, x FROM d WHERE contains(x, chr(10))),
w AS (SELECT r, kind, i, regexp_extract_all({_LOWER.format("u")}, '{_WORDS}') AS ws FROM u),
b AS (SELECT r, kind, i, list_distinct(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) AS bs FROM w WHERE len(ws) > 1),
c AS (SELECT r, kind, i, template, t_size, size, count(*) AS common FROM (SELECT r, kind, i, len(bs) AS size, unnest(bs) AS bigram FROM b) JOIN t USING (bigram) GROUP BY ALL),
m AS (SELECT r, count(*) AS n_matches, string_agg(DISTINCT template, ',' ORDER BY template) AS licenses, max(2.0::DOUBLE * common / (size + t_size)) AS best_dice FROM c WHERE 200 * common >= 80 * (size + t_size) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, licenses, round(coalesce(best_dice, 0::DOUBLE), 6) AS best_dice FROM d LEFT JOIN m USING (r)"""

_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '{_TERMS}') AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERMS}')) AS term FROM benchmark),
c AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM c GROUP BY term), s),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(ts) * n_docs) // n_terms AS m FROM d, s),
scored AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score FROM i JOIN w USING (term) JOIN c USING (term) JOIN m USING (r) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10"""

_RESTS = "|".join(re.escape(c[1:]) for c in [*chat_format.CONTROLS, "<|endoftext|>"])
_OPEN = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in chat_format.TURNS.items())
_OP12 = rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -1, n, ['user', 'assistant'][n + 1], '</s>[INST] ok [/INST]' FROM range(0, 2) AS x(n)),
e AS (SELECT *, length(regexp_replace(t, '([\[<])(\\*)({_RESTS})', '\1\\\2\3', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE role {_OPEN} ELSE {len(chat_format.CLOSED)} + CASE WHEN role IS NULL THEN {len(chat_format.NAMELESS)} ELSE {len(chat_format.NAMED + chat_format.TEXT)} + length(regexp_replace(role, '([\[<])(\\*)({_RESTS})', '\1\\\2\3', 'g')) END END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def _op13() -> str:
    sql = """
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS z
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, (i - 1) // (len(z) // 8) AS part, (i - 1) % (len(z) // 8) AS pos, z[i] AS x FROM (SELECT r, z, unnest(range(1, len(z) + 1)) AS i FROM v)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS c FROM x WHERE r <= 16)"""
    for k in range(7):
        sql += f""",
a{k} AS MATERIALIZED (SELECT r, part, min(d * 16 + entry) % 16 AS entry, min(d * 16 + entry) // 16 AS d FROM (SELECT r, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{k} USING (part, pos) GROUP BY ALL) GROUP BY ALL)"""
        if k < 6:
            sql += f""",
s{k} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} USING (r, part) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{k} LEFT JOIN s{k} USING (part, entry, pos))"""
    return sql + """,
e AS (SELECT r, vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 JOIN v USING (r) GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c6) AS codebooks_sha256 FROM e"""


ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": _OP4, "op5_warc": _OP5, "op8_quality_rules": _OP8, "op9_license_scan": _OP9, "op11_ranked_search": _OP11, "op12_chat_format": _OP12, "op13_vector_codes": _op13(), "quality_ablations": _ABLATIONS,
}
