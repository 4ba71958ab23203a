"""What a reader shows of a section: its layout by type, the parts in their order, and by mode what stands beside each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlens.functions.jsregex import WS, squeeze, trim
from paperlens.operators.reading import display_text, label_rank

# Layouts of section types (others are general), modes, and what waits for a reference translation.
LAYOUTS = {"listening": "questions", "reading_careful": "questions", "reading_bank": "bank", "reading_matching": "matching", "translation": "translation"}
MODES = ("parallel", "sentence", "original", "hideChinese")
LONG = ("directions", "passage", "paragraph", "translation_prompt")
REFERENCE, UNCONFIGURED = "待翻译/待生成参考译文", "未配置翻译接口"
#: Parts of a layout in their order: a name, the block types in it (None: all others), and whether its blocks are small ones.
PARTS = {
    "questions": (("lead", None, False), ("card", ("question", "option"), True)),
    "bank": (("content", None, False), ("word bank", ("word_bank",), True)),
    "matching": (("other", None, False), ("paragraphs", ("paragraph",), False), ("questions", ("question",), True)),
    "translation": (("supporting", None, False), ("source", ("translation_prompt",), False)),
    "general": (("blocks", None, False),),
}


def layout(section_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LAYOUTS.items() for x in kv)), section_type), F.lit("general"))


def _part(block_type: Column) -> Column:
    """rank, name and small of the part that a block stands in, by its layout."""
    out = F.lit(None)
    for name, parts in PARTS.items():
        own = F.lit(None)
        for rank, (part, kinds, small) in enumerate(parts):
            here = F.struct(F.lit(rank).alias("rank"), F.lit(part).alias("name"), F.lit(small).alias("small"))
            own = F.coalesce(own, here) if kinds is None else F.when(block_type.isin(*kinds), here).otherwise(own)
        out = F.when(F.col("layout") == name, own).otherwise(out)
    return out


def is_minutes(text: Column) -> Column:
    """What extraction leaves of a part's heading."""
    return trim(squeeze(text)).rlike(rf"(?i)\A(?:\([0-9]+{WS}+minutes\){WS}*)+(?:with)?\z")


def is_distinct(text: Column, raw: Column) -> Column:
    """Whether a translation says something else than the text, but for white space."""
    return raw.isNotNull() & (trim(squeeze(raw)) != trim(squeeze(text)))


def arranged(blocks: DataFrame, section: list[str]) -> DataFrame:
    """blocks (section, section_type, order_index, block_type, question_number, option_label, original_text and more) with layout, part,
    small and place, without those that are not shown: noise before cards, questions and options without a number, and all
    questions of a number but the last."""
    rows = blocks.withColumn("layout", layout(F.col("section_type")))
    rows = rows.withColumn("_part", _part(F.col("block_type")))
    card = F.col("_part.name") == "card"
    number = [*section, "question_number"]
    last = F.max(F.when(F.col("block_type") == "question", F.col("order_index"))).over(Window.partitionBy(*number))
    rows = rows.withColumn("_last", F.when(card, last))
    hidden = (card & (F.col("question_number").isNull() | ((F.col("block_type") == "question") & (F.col("order_index") < F.col("_last"))))) | ((F.col("_part.name") == "lead") & (F.col("block_type") == "paragraph") & is_minutes(F.col("original_text")))
    written = F.nullif(F.upper(trim(F.coalesce("option_label", F.lit("")))), F.lit(""))
    label = F.coalesce(written, F.nullif(F.regexp_extract("original_text", r"\A\s*([A-Z])\)", 1), F.lit("")))
    option = F.when(written.rlike(r"\A[A-D]\z"), label_rank(written))
    rank = F.when(card & (F.col("block_type") == "question"), -1).when(card, F.coalesce(option, F.lit(99))).when(F.col("_part.name") == "word bank", F.coalesce(label_rank(label), F.lit(99))).otherwise(0)
    order = [F.col("_part.rank"), F.when(card, F.col("question_number")).otherwise(0), rank, F.col("order_index")]
    place = F.row_number().over(Window.partitionBy(*section).orderBy(*order))
    shown = rows.where(~F.coalesce(hidden, F.lit(False))).withColumn("place", place)
    return shown.select(*blocks.columns, "layout", F.col("_part.name").alias("part"), F.col("_part.small").alias("small"), "place")


def shown(rows: DataFrame, modes: tuple[str, ...] = MODES, configured: bool = True) -> DataFrame:
    """Arranged rows once for each mode, with shape (how the text stands) and beside (what stands with it, null for nothing).
    Rows need translated_text and translation_error. Pairs of sentences or paragraphs are those of the passage operators."""
    text, error, given = F.col("original_text"), F.nullif(F.col("translation_error"), F.lit("")), F.nullif(F.col("translated_text"), F.lit(""))
    raw = F.coalesce(error, F.nullif(trim(F.coalesce(given, F.lit(""))), F.lit("")))
    mode, part, kind = F.col("mode"), F.col("part"), F.col("block_type")
    open_ = F.when(part == "word bank", mode != "hideChinese").otherwise(mode.isin("parallel", "sentence"))
    small = open_ & (is_distinct(text, raw) | (raw.isNull() & ~text.rlike(r"\A\s*[0-9]{1,2}\.\s*\z")))
    translation = display_text(error, given, configured)
    pairs = mode.isin("parallel", "sentence") & ~F.col("small") & (kind != "heading") & (part != "source")
    reference = F.coalesce(error, F.when(trim(F.coalesce(given, F.lit(""))) != "", given), F.lit(REFERENCE if configured else UNCONFIGURED))
    shape = (
        F.when(F.col("small"), "small").when(part == "source", "source and reference").when(kind == "heading", "heading").when((mode == "sentence") & kind.isin(*LONG), "pairs of sentences")
        .when(pairs, "pairs of paragraphs").when(mode == "hideChinese", "paragraphs, translation hidden").otherwise("paragraphs")
    )
    beside = F.when(F.col("small"), F.when(small, translation)).when(part == "source", reference).when(pairs, translation)
    return rows.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).withColumns({"shape": shape, "beside": beside})
