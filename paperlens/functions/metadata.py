"""Year, month and kind of a paper from its file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_YEAR = "未识别年份"
YEAR_MONTH = r"(20[0-9]{2})\s*[年.\-_]?\s*(0?[1-9]|1[0-2])\s*月?"


def title(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf\z", "")


def metadata(name: Column) -> Column:
    """A struct of year, month, kind, kind_label. The month's shorter form is tried first, so 12 reads as 1 (kept on purpose)."""
    t = title(name)
    year = F.coalesce(F.nullif(F.regexp_extract(t, YEAR_MONTH, 1), F.lit("")), F.nullif(F.regexp_extract(t, "(20[0-9]{2})", 1), F.lit("")), F.lit(UNKNOWN_YEAR))
    month = F.lpad(F.nullif(F.regexp_extract(t, YEAR_MONTH, 2), F.lit("")), 2, "0")
    kind = F.when(t.rlike("(?i)答案|解析|answer"), "answer").when(t.rlike("(?i)真题|试题|卷[一二三四五六七八九十]|exam|paper"), "exam").otherwise("other")
    label = F.when(kind == "exam", "真题").when(kind == "answer", "答案解析").otherwise("其他资料")
    return F.struct(year.alias("year"), month.alias("month"), kind.alias("kind"), label.alias("kind_label"))


def period(year: Column, month: Column) -> Column:
    return F.when(year == UNKNOWN_YEAR, year).when(month.isNull(), F.concat(year, F.lit("年"))).otherwise(F.concat(year, F.lit("年"), month.cast("int").cast("string"), F.lit("月")))
