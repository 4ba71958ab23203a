"""Signs of garbled page text, and the decision whether a page goes to OCR."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlens.functions.jsregex import WS, named, trim

# Common English words, replacement signs, and the signs that are normal in such pages.
COMMON = "a an and are as at be been by for from had has have he her his in is it its of on or that the their they this to was were which with you".split()
REPLACEMENTS = "[�□■◆◇●]"
ABNORMAL = r"""[^\p{L}\p{N}\s.,;:!?'"()\[\]{}<>/@#$%&*+\-=\\|_`~，。、《》？；：“”‘’（）【】—…·]"""
MOJIBAKE = "[½¼¾¿¡]"


def quality(text: Column) -> Column:
    """A struct of compact_length, ratios, flags, garbled and the reasons for it."""
    parts = F.struct(F.regexp_replace(text, WS + "+", "").alias("compact"), F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0)).alias("words"))
    return named(parts, lambda p: _judged(text, p.compact, p.words))


def _judged(text: Column, compact: Column, words: Column) -> Column:
    counts = F.struct(
        F.char_length(compact).alias("n"),
        F.regexp_count(compact, F.lit(r"[㐀-鿿]")).alias("cjk"),
        F.regexp_count(compact, F.lit(REPLACEMENTS)).alias("replaced"),
        F.regexp_count(compact, F.lit(ABNORMAL)).alias("abnormal"),
        F.regexp_count(compact, F.lit("[~?？]")).alias("tildes"),
        compact.rlike("[~?？]{6,}").alias("dense"),
        (text.rlike("(?i)tOOA") | text.rlike(MOJIBAKE)).alias("mojibake"),
        F.size(words).alias("words"),
        F.size(F.filter(words, lambda w: w.isin(*COMMON))).alias("common"),
    )

    def judge(c: Column) -> Column:
        visible = F.greatest(c.n, F.lit(1))
        replaced, abnormal, cjk = c.replaced / visible, c.abnormal / visible, c.cjk / visible
        dense = c.dense | ((c.tildes >= 8) & (c.tildes / visible > 0.12))
        readable = (c.words >= 8) & (c.common / F.greatest(c.words, F.lit(1)) >= 0.18)
        noise = (c.n >= 120) & (cjk < 0.005) & ~readable & (abnormal > 0.035)
        reasons = F.array_compact(
            F.array(
                F.when(replaced > 0.04, "replacement-chars"),
                F.when(abnormal > 0.06, "abnormal-symbols"),
                F.when(dense, "dense-question-tilde"),
                F.when(c.mojibake, "known-mojibake"),
                F.when(noise, "low-cjk-with-symbol-noise"),
            )
        )
        return F.struct(
            c.n.alias("compact_length"), cjk.alias("cjk_ratio"), abnormal.alias("abnormal_ratio"), replaced.alias("replacement_ratio"), dense.alias("dense"), c.mojibake.alias("mojibake"),
            readable.alias("readable"), (F.size(reasons) > 0).alias("garbled"), reasons.alias("reasons"),
        )

    return named(counts, judge)


def wants_ocr(text: Column, garbled: Column, mode: str = "auto", least: int = 80) -> Column:
    """Never when off, else when always, for empty or short pages, and for garbled ones."""
    if mode in ("off", "false"):
        return F.lit(False)
    if mode == "always":
        return F.lit(True)
    return (trim(text) == "") | (F.char_length(F.regexp_replace(text, WS + "+", "")) < least) | garbled


def ocr_error(page: Column, raw: Column, ocr: Column, reasons: Column, failure: Column) -> Column:
    """What stops a page whose text is empty or garbled and that OCR could not read either: it failed, or gave nothing; null if the page is fine."""
    lost = (F.coalesce(raw, F.lit("")) == "") | (F.size(reasons) > 0)
    number = page.cast("string")
    why = F.when(F.size(reasons) > 0, F.concat(F.lit(" after "), F.array_join(reasons, ", "))).otherwise("")
    failed = F.concat(F.lit("OCR fallback failed on page "), number, F.lit(": "), failure)
    unread = F.concat(F.lit("OCR fallback returned no readable text on page "), number, why)
    return F.when(lost & failure.isNotNull(), failed).when(lost & (F.coalesce(ocr, F.lit("")) == ""), unread)


def page_source(raw: Column, ocr: Column, garbled: Column) -> Column:
    """PDF_TEXT or EMPTY without OCR text; with it OCR if the raw text is garbled or empty, else MIXED."""
    empty = trim(F.coalesce(raw, F.lit(""))) == ""
    return F.when(trim(F.coalesce(ocr, F.lit(""))) == "", F.when(empty, "EMPTY").otherwise("PDF_TEXT")).when(empty | garbled, "OCR").otherwise("MIXED")


def readable_text(source: Column, raw: Column, ocr: Column) -> Column:
    parts = F.concat_ws("\n\n", F.when(raw != "", raw), F.when(ocr != "", ocr))
    return F.when(source == "OCR", F.coalesce(ocr, F.lit(""))).when(source == "MIXED", parts).otherwise(F.coalesce(raw, F.lit("")))
