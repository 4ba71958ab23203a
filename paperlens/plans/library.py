"""Queries over the library: papers, their parts, files, jobs and searches."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlens.functions import metadata as meta
from paperlens.functions import text as T
from paperlens.operators import reading as V
from paperlens.operators import relational as R
from paperlens.operators import search
from paperlens.plans.registry import query
from paperlens.sources import scratch
from paperlens.sources import tables as S


@query(
    """SELECT source, count(*) AS documents, count(DISTINCT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))) AS distinct_texts,
    CAST(sum(n_words) AS BIGINT) AS words FROM (SELECT source, text, len(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)*')) AS n_words FROM documents) GROUP BY source"""
)
def q_corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = S.documents(spark, d).select("source", T.text_hash(F.col("text")).alias("hash"), F.size(T.words(F.col("text"))).alias("n_words"))
    # Two-level grouping: distinct hashes per source without one large set.
    per_hash = rows.groupBy("source", "hash").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    return per_hash.groupBy("source").agg(F.sum("n").alias("documents"), F.count("hash").alias("distinct_texts"), F.sum("w").alias("words"))


@query(
    """SELECT o_orderkey AS paper_id, coalesce(n, 0) AS n_items, coalesce(s, 0) AS n_sources FROM orders
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    LEFT JOIN (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) ON k = o_orderkey"""
)
def q_paper_counts(spark: SparkSession, d: str) -> DataFrame:
    items = S.items(spark, d)
    return R.with_counts(S.papers(spark, d).select("paper_id"), "paper_id", items=items, sources=items.select("paper_id", "source").distinct())


@query(
    """SELECT o_orderkey AS paper_id, coalesce(n, 0) AS n_items, coalesce(flags, '') AS flags FROM orders LEFT JOIN
    (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag, l_partkey) AS flags FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def q_paper_nested(spark: SparkSession, d: str) -> DataFrame:
    found = R.nested(S.papers(spark, d).select("paper_id"), S.items(spark, d), "paper_id", ["order_index", "flag", "part"], ["flag"])
    return found.select(
        "paper_id", F.coalesce(F.size("children"), F.lit(0)).alias("n_items"),
        F.coalesce(F.expr("array_join(transform(children, c -> concat(c.order_index, c.flag)), ',')"), F.lit("")).alias("flags"),
    ).withColumn("n_items", F.greatest("n_items", F.lit(0)))


@query("SELECT o_orderkey AS paper_id, o_orderstatus AS status, l.n AS n_items FROM orders JOIN (SELECT max(o_orderkey) // 2 AS k FROM orders) ON o_orderkey = k JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def q_paper_by_id(spark: SparkSession, d: str) -> DataFrame:
    papers = S.papers(spark, d)
    wanted = papers.agg((F.max("paper_id") / 2).cast("long").alias("paper_id"))
    one = papers.join(F.broadcast(wanted), "paper_id").select("paper_id", "status")  # an aggregate of one row
    return one.join(S.items(spark, d), "paper_id").groupBy("paper_id", "status").agg(F.count("*").alias("n_items"))


@query(
    """SELECT o_orderkey AS paper_id, coalesce(stage, 'QUEUED') AS stage FROM orders LEFT JOIN
    (SELECT user_id, event_type AS stage FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) ON user_id = o_orderkey"""
)
def q_paper_job(spark: SparkSession, d: str) -> DataFrame:
    last = R.latest(S.jobs(spark, d).select("paper_id", "ts", "event_id", "stage"), ["paper_id"], ["ts", "event_id"])
    return S.papers(spark, d).select("paper_id").join(last.select("paper_id", "stage"), "paper_id", "left").select("paper_id", F.coalesce("stage", F.lit("QUEUED")).alias("stage"))


@query("SELECT o_orderkey AS paper_id, o_orderstatus AS status FROM orders")
def q_project(spark: SparkSession, d: str) -> DataFrame:
    return S.papers(spark, d).select("paper_id", "status")


@query(
    """SELECT conv_id AS paper_id, count(*) AS hits, min(turn) AS first_hit FROM conversations
    WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') OR turn = TRY_CAST('the' AS INTEGER) GROUP BY 1"""
)
def q_block_search(spark: SparkSession, d: str) -> DataFrame:
    q, blocks = "the", S.blocks(spark, d)
    condition = R.contains_folded(F.col("original_text"), q) | (F.col("order_index") == F.lit(q).try_cast("int"))
    found = R.filtered_children(blocks.select("paper_id").distinct(), blocks, "paper_id", condition)
    return found.groupBy("paper_id").agg(F.count("*").alias("hits"), F.min("order_index").alias("first_hit"))


@query("SELECT conv_id AS paper_id, turn AS order_index FROM conversations WHERE contains(lower(text), 'la') OR CAST(turn AS VARCHAR) = 'la'")
def q_client_search(spark: SparkSession, d: str) -> DataFrame:
    q = "La".lower()
    return S.blocks(spark, d).where(F.contains(F.lower("original_text"), F.lit(q)) | (F.col("order_index").cast("string") == q)).select("paper_id", "order_index")


#: Texts that are looked for: words and parts of words, a number, signs, and one that is nowhere.
NEEDLES = (" The ", "schen", "ion.", "7", "éÈ", "on the w", "zzzzqq")
_SEARCHED = "b AS (SELECT conv_id AS paper_id, turn AS order_index, role, text AS original_text, reverse(text) AS translated_text, turn % 5 + conv_id % 3 AS page_number FROM conversations)"


def _searchable(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with a translation (the text from behind) and a page number."""
    page = F.col("order_index") % 5 + F.col("paper_id") % 3
    return S.blocks(spark, d).select("paper_id", "order_index", F.col("block_type").alias("role"), "original_text", F.reverse("original_text").alias("translated_text"), page.alias("page_number"))


def _indexed(spark: SparkSession, d: str, fold: str) -> str:
    path = scratch.folder(spark, "index")
    search.build(_searchable(spark, d), ["original_text", "translated_text"], path, (fold,))
    return path


_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NEEDLES = "q(needle) AS (VALUES " + ", ".join(f"('{n}')" for n in NEEDLES) + ")"


@query(
    f"""WITH {_SEARCHED}, {_NEEDLES} SELECT needle, paper_id, order_index FROM q, b WHERE contains({_AZ.format("original_text")}, {_AZ.format("trim(needle)")})
    OR contains({_AZ.format("translated_text")}, {_AZ.format("trim(needle)")}) OR page_number = TRY_CAST(trim(needle) AS BIGINT)"""
)
def q_search_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose text or translation contains what is looked for, or whose page it is, by the index."""
    path = _indexed(spark, d, "ascii")
    hits = [search.found(spark, path, "ascii", n, ["original_text", "translated_text"], {"page_number": "integer"}).select(F.lit(n).alias("needle"), "paper_id", "order_index") for n in NEEDLES]
    return reduce(DataFrame.union, hits)


@query(
    f"""WITH {_SEARCHED}, {_NEEDLES} SELECT needle, paper_id, order_index FROM q, b WHERE role = 'assistant' AND (contains(lower(original_text), lower(trim(needle))) OR contains(lower(translated_text), lower(trim(needle)))
    OR CAST(page_number AS VARCHAR) = lower(trim(needle)) OR CAST(order_index AS VARCHAR) = lower(trim(needle)))"""
)
def q_search_sections(spark: SparkSession, d: str) -> DataFrame:
    """The reader's search, inside the sections chosen (those of one role), by page and question number, too."""
    path = _indexed(spark, d, "lower")
    numbers = {"page_number": "text", "order_index": "text"}
    hits = [search.found(spark, path, "lower", n, ["original_text", "translated_text"], numbers, F.col("role") == "assistant").select(F.lit(n).alias("needle"), "paper_id", "order_index") for n in NEEDLES]
    return reduce(DataFrame.union, hits)


@query("SELECT conv_id AS paper_id, turn AS order_index, role AS block_type FROM conversations WHERE role = 'user'")
def q_section_type_filter(spark: SparkSession, d: str) -> DataFrame:
    kinds, wanted = ("user", "assistant", "system"), "user"
    blocks = S.blocks(spark, d).select("paper_id", "order_index", "block_type")
    return blocks.where(F.col("block_type") == wanted) if wanted in kinds else blocks


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Papers with file names made of their date and status."""
    kind = F.when(F.col("status") == "F", "真题").when(F.col("status") == "O", "答案解析").otherwise("材料")
    return S.papers(spark, d).select("paper_id", "owner_id", "created_at", F.concat(F.date_format("created_at", "yyyy"), F.lit("年"), F.date_format("created_at", "MM"), F.lit("月六级"), kind, F.lit("（"), F.col("paper_id").cast("string"), F.lit("）.PDF")).alias("name"))


_NAMED = """n AS (SELECT o_orderkey AS paper_id, strftime(o_orderdate, '%Y') || '年' || strftime(o_orderdate, '%m') || '月六级' || CASE o_orderstatus WHEN 'F' THEN '真题' WHEN 'O' THEN '答案解析' ELSE '材料' END || '（' || o_orderkey || '）.PDF' AS name FROM orders),
t AS (SELECT paper_id, name, regexp_replace(name, '(?i)\\.pdf$', '') AS title FROM n),
e AS (SELECT *, nullif(regexp_extract(title, '(20[0-9]{2})\\s*[年.\\-_]?\\s*(0?[1-9]|1[0-2])\\s*月?', 1), '') AS y1, nullif(regexp_extract(title, '(20[0-9]{2})\\s*[年.\\-_]?\\s*(0?[1-9]|1[0-2])\\s*月?', 2), '') AS m1, nullif(regexp_extract(title, '(20[0-9]{2})', 1), '') AS y2 FROM t),
m AS (SELECT paper_id, name, title, coalesce(y1, y2, '未识别年份') AS year, lpad(m1, 2, '0') AS month, CASE WHEN regexp_matches(title, '(?i)答案|解析|answer') THEN 'answer' WHEN regexp_matches(title, '(?i)真题|试题|卷[一二三四五六七八九十]|exam|paper') THEN 'exam' ELSE 'other' END AS kind FROM e)"""


def _with_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).withColumn("m", meta.metadata(F.col("name"))).select("paper_id", "owner_id", "name", "created_at", meta.title(F.col("name")).alias("title"), "m.*")


@query(f"WITH {_NAMED} SELECT paper_id, title, year, month, kind, CASE kind WHEN 'exam' THEN '真题' WHEN 'answer' THEN '答案解析' ELSE '其他资料' END AS kind_label FROM m")
def q_paper_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _with_metadata(spark, d).select("paper_id", "title", "year", "month", "kind", "kind_label")


@query(f"WITH {_NAMED} SELECT paper_id, CASE WHEN year = '未识别年份' THEN year WHEN month IS NULL THEN year || '年' ELSE year || '年' || CAST(month AS INTEGER) || '月' END AS period FROM m")
def q_period_label(spark: SparkSession, d: str) -> DataFrame:
    return _with_metadata(spark, d).select("paper_id", meta.period(F.col("year"), F.col("month")).alias("period"))


@query(f"WITH {_NAMED} SELECT paper_id, year, kind FROM m WHERE kind = 'exam' AND year = '2001'")
def q_library_filter(spark: SparkSession, d: str) -> DataFrame:
    kind, year = "exam", "2001"
    rows = _with_metadata(spark, d).select("paper_id", "year", "kind")
    rows = rows.where(F.col("kind") == kind) if kind in ("exam", "answer") else rows
    return rows.where(F.col("year") == year) if re.fullmatch("20[0-9]{2}", year) else rows


@query(
    f"""WITH {_NAMED} SELECT o_custkey AS owner_id, year, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY year DESC) AS INTEGER) AS place, count(*) AS n, string_agg(title, '|' ORDER BY o_orderdate DESC, paper_id DESC) AS titles
    FROM m JOIN orders ON o_orderkey = paper_id GROUP BY 1, 2"""
)
def q_library_groups(spark: SparkSession, d: str) -> DataFrame:
    """An owner's papers by year, the latest year first and the newest paper first."""
    newest = F.array_sort(F.collect_list(F.struct("created_at", "paper_id", "title")), lambda a, b: F.when(F.struct(a.created_at, a.paper_id) > F.struct(b.created_at, b.paper_id), -1).otherwise(1))
    groups = _with_metadata(spark, d).groupBy("owner_id", "year").agg(F.count("*").alias("n"), F.array_join(F.transform(newest, lambda x: x.title), "|").alias("titles"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("year"))))


@query(f"WITH {_NAMED} SELECT DISTINCT year FROM m WHERE year <> '未识别年份'")
def q_available_years(spark: SparkSession, d: str) -> DataFrame:
    return _with_metadata(spark, d).where(F.col("year") != meta.UNKNOWN_YEAR).select("year").distinct().orderBy(F.desc("year"))


@query(f"WITH {_NAMED} SELECT count(*) FILTER (kind = 'exam') AS exams, count(*) FILTER (kind = 'answer') AS answers, count(*) AS papers FROM m")
def q_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return _with_metadata(spark, d).agg(F.count_if(F.col("kind") == "exam").alias("exams"), F.count_if(F.col("kind") == "answer").alias("answers"), F.count("*").alias("papers"))


_NAME = "CASE WHEN page_id % 3 = 0 THEN url || '.PDF' ELSE url END"


@query(f"SELECT page_id, lower({_NAME}) LIKE '%.pdf' OR page_id % 5 = 0 AS accepted FROM pages")
def q_upload_accept(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files, some with the ending and some with the type that an upload needs."""
    kind = F.when(F.col("page_id") % 5 == 0, "application/pdf").otherwise("text/html")
    return S.table(spark, d, "pages").select("page_id", R.acceptable(F.expr(_NAME), kind).alias("accepted"))


_FILES = "SELECT doc_id, source || CASE lang WHEN 'fr' THEN '.txt' ELSE '.Pdf' END AS name, n_chars // 100 AS size, lang AS modified FROM documents"


@query(
    f"""WITH f AS ({_FILES}), q AS (SELECT * FROM f WHERE doc_id % 2 = 0) SELECT doc_id, name FROM q
    UNION ALL SELECT min(doc_id), name FROM f WHERE doc_id % 2 = 1 AND name LIKE '%.Pdf' AND NOT EXISTS (SELECT 1 FROM q WHERE q.name = f.name AND q.size = f.size AND q.modified = f.modified) GROUP BY name, size, modified"""
)
def q_upload_dedup(spark: SparkSession, d: str) -> DataFrame:
    """A queue and the files that join it: acceptable ones whose key is neither in it nor has just joined."""
    files = S.documents(spark, d).selectExpr("doc_id", "source || CASE lang WHEN 'fr' THEN '.txt' ELSE '.Pdf' END AS name", "n_chars div 100 AS size", "lang AS modified")
    incoming = files.where("doc_id % 2 = 1").where(R.acceptable(F.col("name"), F.lit("")))
    return R.enqueued(files.where("doc_id % 2 = 0"), incoming, ["name", "size", "modified"], ["doc_id"]).select("doc_id", "name")


@query("SELECT page_id, sha256(html) AS file_hash, octet_length(encode(html)) AS n_bytes FROM pages")
def q_file_hash(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("html").cast("binary")
    return S.table(spark, d, "pages").select("page_id", F.sha2(raw, 256).alias("file_hash"), F.octet_length(raw).cast("long").alias("n_bytes"))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN sha256(text) ELSE 'known-' || quality END AS file_hash FROM documents LEFT JOIN labels USING (doc_id)")
def q_hash_backfill(spark: SparkSession, d: str) -> DataFrame:
    known = S.table(spark, d, "labels").select("doc_id", F.concat(F.lit("known-"), F.col("quality").cast("string")).alias("file_hash"))
    return S.documents(spark, d).join(known, "doc_id", "left").select("doc_id", F.coalesce("file_hash", F.sha2("text", 256)).alias("file_hash"))


@query(
    """WITH h AS (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS text_hash, coalesce(toxic, 0) = 1 AS failed FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, coalesce(first, -1) AS original, doc_id <> coalesce(first, doc_id) AS duplicate FROM h LEFT JOIN (SELECT text_hash, max(doc_id) AS first FROM h WHERE NOT failed GROUP BY 1) USING (text_hash)"""
)
def q_dup_lookup(spark: SparkSession, d: str) -> DataFrame:
    failed = S.table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("failed"))
    hashes = scratch.once(S.documents(spark, d).select("doc_id", T.text_hash(F.col("text")).alias("text_hash")), "hashes")
    rows = hashes.join(failed, "doc_id", "left").select("doc_id", "text_hash", F.coalesce("failed", F.lit(False)).alias("failed"))
    newest = rows.where(~F.col("failed")).groupBy("text_hash").agg(F.max("doc_id").alias("original"))
    return rows.join(newest, "text_hash", "left").select("doc_id", F.coalesce("original", F.lit(-1)).alias("original"), (F.col("doc_id") != F.coalesce("original", "doc_id")).alias("duplicate"))


@query("SELECT DISTINCT source FROM documents")
def q_distinct_sorted(spark: SparkSession, d: str) -> DataFrame:
    return S.documents(spark, d).select("source").distinct().orderBy(F.collate("source", "UNICODE"))


@query(
    """WITH l AS (SELECT user_id AS paper_id, event_type AS stage, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT paper_id, CASE WHEN stage NOT IN ('error', 'purchase') AND ts < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE THEN 'FAILED' ELSE stage END AS status FROM l"""
)
def q_stale_sweep(spark: SparkSession, d: str) -> DataFrame:
    jobs = S.jobs(spark, d).select("paper_id", "ts", "event_id", "stage")
    last = R.latest(jobs, ["paper_id"], ["ts", "event_id"]).crossJoin(F.broadcast(jobs.agg(F.max("ts").alias("now"))))  # one row
    stale = ~F.col("stage").isin("error", "purchase") & (F.col("ts") < F.col("now") - F.expr("INTERVAL 10 MINUTES"))
    return last.select("paper_id", F.when(stale, "FAILED").otherwise(F.col("stage")).alias("status"))


@query(
    """WITH l AS (SELECT user_id AS paper_id, event_type AS stage, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT event_id FROM events WHERE user_id IN (SELECT paper_id FROM l WHERE stage NOT IN ('error', 'purchase') AND ts < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)"""
)
def q_stale_jobs(spark: SparkSession, d: str) -> DataFrame:
    stale = q_stale_sweep(spark, d).where("status = 'FAILED'")
    return S.jobs(spark, d).join(stale, "paper_id", "left_semi").select("event_id")


@query("SELECT user_id AS paper_id, event_type AS stage, value AS progress FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_status_latest(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(S.jobs(spark, d).select("paper_id", "ts", "event_id", "stage", "progress"), ["paper_id"], ["ts", "event_id"]).select("paper_id", "stage", "progress")


@query("SELECT user_id AS paper_id, event_type AS stage, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS finished FROM events GROUP BY 1, 2")
def q_job_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = S.jobs(spark, d).groupBy("paper_id", "stage").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("paper_id", "stage", F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("finished"))


@query("""SELECT event_id, '{"paperId":' || user_id || ',"stage":"' || event_type || '"}' AS data FROM events""")
def q_status_event_json(spark: SparkSession, d: str) -> DataFrame:
    return S.jobs(spark, d).select("event_id", F.to_json(F.struct(F.col("paper_id").alias("paperId"), "stage")).alias("data"))


@query("SELECT doc_id, CAST(8 + round(38.0 * row_number() OVER (PARTITION BY source ORDER BY doc_id) / count(*) OVER (PARTITION BY source)) AS BIGINT) AS progress FROM documents")
def q_page_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = R.numbered(S.documents(spark, d).select("doc_id", "source"), "source", "doc_id", "place", "total")
    return rows.select("doc_id", (8 + F.round(F.lit(38.0) * (F.col("place") + 1) / F.col("total"))).cast("long").alias("progress"))


@query("SELECT conv_id AS paper_id, least(100, CAST(round(100.0 * count(*) FILTER (role = 'assistant') / count(*)) AS BIGINT)) AS percent FROM conversations GROUP BY 1")
def q_progress_percent(spark: SparkSession, d: str) -> DataFrame:
    share = F.try_divide(F.lit(100.0) * F.count_if(F.col("block_type") == "assistant"), F.count("*"))
    return S.blocks(spark, d).groupBy("paper_id").agg(F.least(F.lit(100), F.coalesce(F.round(share), F.lit(0)).cast("long")).alias("percent"))


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def q_progress_changes(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("stage").over(Window.partitionBy("paper_id").orderBy("ts", "event_id"))
    return S.jobs(spark, d).select("event_id", "stage", before.alias("before")).where(~F.col("before").eqNullSafe(F.col("stage"))).select("event_id")


@query(
    """WITH o AS (SELECT user_id, event_type AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events),
    s AS (SELECT user_id, coalesce(arg_max(v, o) FILTER (t = 'signup'), 0) AS total, arg_max(t, o) FILTER (t IN ('signup', 'click', 'purchase')) AS moved, arg_max(v, o) FILTER (t IN ('signup', 'click', 'purchase')) AS v,
      arg_max(t, o) FILTER (t IN ('signup', 'purchase', 'error')) AS turned FROM o GROUP BY 1)
    SELECT user_id AS paper_id, CASE turned WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' ELSE 'idle' END AS status, total, CASE moved WHEN 'click' THEN v WHEN 'purchase' THEN total ELSE 0 END AS completed FROM s"""
)
def q_progress_state(spark: SparkSession, d: str) -> DataFrame:
    """Events as a run's progress: a signup starts it anew with a total, a click sets how much is done, a purchase finishes it, an error fails it."""
    step = F.when(F.col("stage") == "signup", "start").when(F.col("stage") == "click", "update").when(F.col("stage") == "purchase", "finish").when(F.col("stage") == "error", "fail")
    return R.run_state(S.jobs(spark, d).select("paper_id", step.alias("step"), F.col("progress").alias("value"), "ts", "event_id"), "paper_id", ["ts", "event_id"])


@query("SELECT event_type AS stage, count(*) AS n, count(*) FILTER (value >= 40) AS finished, sum(least(82, CAST(round(value / 100 * 82) AS BIGINT)))::BIGINT AS percents, sum(CAST(floor(value * 1000 / 1000) AS BIGINT))::BIGINT AS seconds FROM events GROUP BY 1")
def q_upload_progress(spark: SparkSession, d: str) -> DataFrame:
    percent, seconds = F.least(F.lit(82), F.round(F.col("progress") / 100 * 82).cast("long")), F.greatest(F.lit(0), F.floor(F.col("progress") * 1000 / 1000))
    return S.jobs(spark, d).groupBy("stage").agg(F.count("*").alias("n"), F.count_if(F.col("progress") >= 40).alias("finished"), F.sum(percent).alias("percents"), F.sum(seconds).alias("seconds"))


@query("SELECT source, lang, doc_id, n_chars + CASE WHEN source = 'src0' THEN 1 ELSE 0 END AS n_chars FROM documents")
def q_reprocess_overwrite(spark: SparkSession, d: str) -> DataFrame:
    base = S.documents(spark, d).select("source", "lang", "doc_id", "n_chars")
    again = base.where("source = 'src0'").withColumn("n_chars", F.col("n_chars") + 1)
    return R.replaced(base, again, "source")


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN '****' ELSE substr(p_name, 1, 4) || '****' || right(p_name, 4) END AS masked FROM part")
def q_mask_key(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "part").select("p_partkey", T.masked(F.col("p_name")).alias("masked"))


@query("SELECT page_id, regexp_replace(trim(url), '/+$', '') AS base FROM pages")
def q_base_url(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "pages").select("page_id", T.base_url(F.col("url")).alias("base"))


@query("SELECT page_id, substr(trim(regexp_replace(url, '[^0-9A-Za-z_.\\x{4e00}-\\x{9fff}-]+', '_', 'g'), '_'), 1, 120) AS name FROM pages")
def q_safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


_SHOT = "regexp_replace(url, '^.*/', '') || CASE WHEN page_id % 2 = 0 THEN '.png' ELSE '.txt' END"


@query(f"WITH f AS (SELECT {_SHOT} AS name FROM pages) SELECT arg_min(name, (coalesce(TRY_CAST(nullif(regexp_extract(name, '([0-9]+)', 1), '') AS BIGINT), 9223372036854775807), name)) AS first FROM f WHERE name LIKE '%.png'")
def q_natural_sort_first(spark: SparkSession, d: str) -> DataFrame:
    """Of the pictures in a folder the first by the number in its name, then by name."""
    files = S.table(spark, d, "pages").select(F.expr(_SHOT).alias("name")).where(F.col("name").endswith(".png"))
    number = F.coalesce(F.nullif(F.regexp_extract("name", "([0-9]+)", 1), F.lit("")).try_cast("long"), F.lit(2**63 - 1))
    return files.agg(F.min_by("name", F.struct(number, "name")).alias("first"))


@query(
    """WITH s AS (SELECT list_extract(['PARSING', 'OCR', 'STRUCTURING', 'TRANSLATING', 'READY', 'FAILED', 'QUEUED'], event_id % 8 + 1) AS stage FROM events)
    SELECT coalesce(stage, '-') AS stage, CASE stage WHEN 'PARSING' THEN '抽取文本' WHEN 'OCR' THEN 'OCR 识别' WHEN 'STRUCTURING' THEN '识别题型' WHEN 'TRANSLATING' THEN '生成翻译' WHEN 'READY' THEN '完成' WHEN 'FAILED' THEN '失败' ELSE '等待处理' END AS stage_label,
    CASE stage WHEN 'READY' THEN '完成' WHEN 'FAILED' THEN '失败' WHEN 'PROCESSING' THEN '处理中' ELSE '排队' END AS status_label, count(*) AS n FROM s GROUP BY stage"""
)
def q_stage_labels(spark: SparkSession, d: str) -> DataFrame:
    stage = F.get(F.array(*map(F.lit, ("PARSING", "OCR", "STRUCTURING", "TRANSLATING", "READY", "FAILED", "QUEUED"))), (F.col("event_id") % 8).cast("int"))
    rows = S.jobs(spark, d).groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("stage", F.lit("-")).alias("stage"), V.label(F.col("stage"), V.STAGE_LABELS, V.WAITING).alias("stage_label"), V.label(F.col("stage"), V.STATUS_LABELS, V.QUEUED).alias("status_label"), "n")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def q_time_labels(spark: SparkSession, d: str) -> DataFrame:
    return S.jobs(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def q_lenient_json(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit("Sure, here it is: "), F.col("props"), F.lit(" done."))
    return S.jobs(spark, d).select("event_id", F.from_json(T.first_object(wrapped), "k int").k.alias("k"))


@query("SELECT env, name, arg_max(value, doc_id) AS value FROM (SELECT source AS env, doc_id, 'KEY_' || upper(lang) AS name, CAST(n_chars AS VARCHAR) AS value FROM documents) GROUP BY ALL")
def q_env_parse(spark: SparkSession, d: str) -> DataFrame:
    """Settings files: one per source, a line per document; of repeated names the last line counts."""
    lines = S.documents(spark, d).select(F.col("source").alias("env"), F.col("doc_id").alias("line"), F.concat(F.lit(" KEY_"), F.upper("lang"), F.lit('="'), F.col("n_chars").cast("string"), F.lit('"')).alias("text"))
    pattern = r'^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"?([^"]*)"?\s*$'
    parsed = lines.select("env", "line", F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("value")).where("name <> ''")
    return parsed.groupBy("env", "name").agg(F.max_by("value", "line").alias("value"))


@query("SELECT source, CAST(round(avg(least(100, doc_id % 120))) AS BIGINT) AS percent, count(*) FILTER (doc_id % 120 < 100) AS pending, count(*) FILTER (doc_id % 120 >= 100) AS finished FROM documents GROUP BY 1")
def q_upload_overall(spark: SparkSession, d: str) -> DataFrame:
    """Documents as uploads of a source: the percent of all, and how many are still to come."""
    done = F.least(F.lit(100), F.col("doc_id") % 120)
    rows = S.documents(spark, d).groupBy("source")
    return rows.agg(F.round(F.avg(done)).cast("long").alias("percent"), F.count_if(done < 100).alias("pending"), F.count_if(done >= 100).alias("finished"))


@query("SELECT page_id, b AS base, b || '/models' AS first, CASE WHEN regexp_matches(b, '(?i)/v1$') THEN '' ELSE b || '/v1/models' END AS second FROM (SELECT page_id, regexp_replace(trim(url), '/+$', '') || CASE page_id % 3 WHEN 0 THEN '/V1' ELSE '' END AS b FROM pages)")
def q_model_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses at which a provider may list its models, in order."""
    base = F.concat(F.regexp_replace(F.trim("url"), "/+$", ""), F.when(F.col("page_id") % 3 == 0, "/V1").otherwise(""))
    urls = R.model_urls(F.col("base"))
    rows = S.table(spark, d, "pages").select("page_id", base.alias("base"))
    return rows.select("page_id", "base", F.get(urls, F.lit(0)).alias("first"), F.coalesce(F.get(urls, F.lit(1)), F.lit("")).alias("second"))


@query(
    r"""WITH l AS (SELECT source AS env, doc_id AS line, CASE doc_id % 4 WHEN 0 THEN '# ' || lang WHEN 1 THEN 'KEY_' || upper(lang) || '="old"' WHEN 2 THEN ' other = ' || n_chars ELSE '' END AS text, CASE doc_id % 4 WHEN 1 THEN 'KEY_' || upper(lang) END AS name FROM documents),
    v AS (SELECT source AS env, 'KEY_' || upper(lang) AS name, max(doc_id) || ' "\' AS value FROM documents WHERE lang <> 'en' GROUP BY ALL)
    SELECT env, line, CASE WHEN value IS NULL THEN text ELSE name || '="' || replace(replace(value, '\', '\\'), '"', '\"') || '"' END AS text FROM l LEFT JOIN v USING (env, name)
    UNION ALL SELECT env, -1, name || '="' || replace(replace(value, '\', '\\'), '"', '\"') || '"' FROM v WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.env = v.env AND l.name = v.name)"""
)
def q_env_save(spark: SparkSession, d: str) -> DataFrame:
    """Settings files with new values: lines of known names are written anew and quoted, all others stay, new names follow (line -1)."""
    docs, kind = S.documents(spark, d), F.col("doc_id") % 4
    key = F.concat(F.lit("KEY_"), F.upper("lang"))
    text = F.when(kind == 0, F.concat(F.lit("# "), "lang")).when(kind == 1, F.concat(key, F.lit('="old"'))).when(kind == 2, F.concat(F.lit(" other = "), F.col("n_chars").cast("string"))).otherwise("")
    values = docs.where("lang <> 'en'").groupBy(F.col("source").alias("env"), key.alias("name")).agg(F.concat(F.max("doc_id").cast("string"), F.lit(' "\\')).alias("value"))
    return R.settings_saved(docs.select(F.col("source").alias("env"), F.col("doc_id").alias("line"), text.alias("text")), values)
