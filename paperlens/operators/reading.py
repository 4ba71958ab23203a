"""What a reader sees: groups of questions, ranges, progress, display rules, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlens.functions.jsregex import END, WS, squeeze, trim
from paperlens.functions.text import context
from paperlens.operators.grammar import type_from_number

#: Fixed value: vocabulary cards that a reader keeps.
CARDS = 200


# Labels of stages and states of a job, and those of all others.
STAGE_LABELS = {"PARSING": "抽取文本", "OCR": "OCR 识别", "STRUCTURING": "识别题型", "TRANSLATING": "生成翻译", "READY": "完成", "FAILED": "失败"}
STATUS_LABELS = {"READY": "完成", "FAILED": "失败", "PROCESSING": "处理中"}
WAITING, QUEUED = "等待处理", "排队"
# Labels of section types, in their order.
TYPE_LABELS = {"writing": "写作", "listening": "听力", "reading_bank": "阅读 Section A 选词填空", "reading_matching": "阅读 Section B 长篇匹配", "reading_careful": "阅读 Section C 仔细阅读", "translation": "翻译", "unknown": "未分类"}
# Groups of the directory, in order, and the section types in them.
DIRECTORY = {"写作": ("writing",), "听力": ("listening",), "阅读": ("reading_bank", "reading_matching", "reading_careful"), "翻译": ("translation",), "未分类": ("unknown",)}
# What the evidence of a section says of its type; the first pattern that fits counts.
EVIDENCE = (
    (rf"(?i)Part{WS}*I{END}.*Writing", "writing"),
    (rf"(?i)Part{WS}*II{END}.*Listening|Section{WS}+[ABC]{WS}*(?:长对话|短文|讲座)", "listening"),
    (rf"(?i)Section{WS}*A{END}.*(?:选词填空|word bank)", "reading_bank"),
    (rf"(?i)Section{WS}*B{END}.*(?:长篇匹配|matching)", "reading_matching"),
    (rf"(?i)Section{WS}*C{END}.*(?:仔细阅读|careful)", "reading_careful"),
    (rf"(?i)Part{WS}*IV{END}.*Translation", "translation"),
)


def label(value: Column, labels: dict[str, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), value), F.lit(other))


def type_place(section_type: Column) -> Column:
    """Place of a section type in their order, from 0; null for none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, TYPE_LABELS)), section_type), F.lit(0)).cast("int") - 1


def directory_group(section_type: Column) -> Column:
    """A struct of place and label of the group that a section stands in."""
    out = F.lit(None)
    for place, (name, kinds) in enumerate(DIRECTORY.items()):
        out = F.when(section_type.isin(*kinds), F.struct(F.lit(place).alias("place"), F.lit(name).alias("label"))).otherwise(out)
    return out


def type_by_evidence(evidence: Column, least_number: Column, own: Column) -> Column:
    """Type of a section by its title, subtitle and first blocks, else by its smallest question number, else its own."""
    text = trim(squeeze(evidence))
    out = F.when(least_number.isNotNull(), type_from_number(least_number)).otherwise(own)
    for pattern, kind in reversed(EVIDENCE):
        out = F.when(text.rlike(pattern), kind).otherwise(out)
    return out


def label_rank(label: Column) -> Column:
    """A to Z as 0 to 25, anything else last."""
    upper = F.upper(F.trim(label))
    return F.when(upper.rlike(r"\A[A-Z]\z"), F.ascii(upper) - 65)


def question_groups(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows (keys, kind, label, text, order) by question: the last question's text, options by label and order."""
    question = F.max_by(F.when(F.col("kind") == "question", F.col("text")), F.when(F.col("kind") == "question", F.struct(*order)))
    entry = F.struct(F.coalesce(label_rank(F.col("label")), F.lit(99)).alias("rank"), *order, "label", "text")
    options = F.array_sort(F.collect_list(F.when(F.col("kind") == "option", entry)))
    return rows.groupBy(*keys).agg(question.alias("question"), options.alias("options"))


def span(first: Column, last: Column, prefix: str = "", none: str = "") -> Column:
    return F.when(first.isNull(), none).when(last.isNull() | (first == last), F.concat(F.lit(prefix), first.cast("string"))).otherwise(F.concat(F.lit(prefix), first.cast("string"), F.lit("-"), last.cast("string")))


def section_progress(done: Column, total: Column) -> Column:
    return F.when(total == 0, "已解析").when(done == total, "已翻译").when(done > 0, F.concat_ws("/", done.cast("string"), total.cast("string"))).otherwise("待翻译")


def display_text(error: Column, translation: Column, configured: bool = True) -> Column:
    given = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(given(error), given(translation), F.lit("待翻译" if configured else "未配置翻译接口"))


def is_noise(text: Column) -> Column:
    return text.rlike(rf"(?i)\A(?:\([0-9]+{WS}+minutes\){WS}*)+(?:with)?\z") | text.rlike(r"\A[0-9]{1,2}\.?\z")


def vocabulary(words: DataFrame, keys: list[str], most: int = CARDS) -> DataFrame:
    """words (keys, word, at): per key the `most` last met words, with count and last place."""
    cards = words.groupBy(*keys, "word").agg(F.count("*").alias("count"), F.max("at").alias("last"))
    return cards.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("last"), "word"))).where(F.col("place") <= most)


def with_context(cards: DataFrame, texts: DataFrame) -> DataFrame:
    """Cards with the context of their last place. texts: at, text. Only cards that stayed meet a text."""
    return cards.join(texts.select(F.col("at").alias("last"), context(F.col("text")).alias("context")), "last", "left")


def csv_line(*cells: Column) -> Column:
    """Cells quoted, quotes doubled, commas between."""
    return F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells))
