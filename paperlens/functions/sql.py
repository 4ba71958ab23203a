"""What SQL users get: scalar functions in SQL, and table functions over the walks."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from paperlens.operators import grammar as G

# JavaScript's white space, as in functions.jsregex, for SQL strings.
_S = r"[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
SCALARS = {
    "exam_text_hash(t STRING) RETURNS STRING": f"sha2(lower(regexp_replace(regexp_replace(t, '{_S}+', ' '), '^ | $', '')), 256)",
    "exam_section_type(n INT) RETURNS STRING": "CASE " + " ".join(f"WHEN n BETWEEN {a} AND {b} THEN '{kind}'" for a, b, kind in G.NUMBERS) + " ELSE 'unknown' END",
    "exam_percent(done DOUBLE, total DOUBLE) RETURNS BIGINT": "CASE WHEN total <= 0 THEN 0 ELSE least(100, cast(round(done / total * 100) AS BIGINT)) END",
    "exam_masked(t STRING) RETURNS STRING": "CASE WHEN char_length(t) <= 8 THEN '****' ELSE concat(left(t, 4), '****', right(t, 4)) END",
}


def _table(argument: AnalyzeArgument, needed: tuple[str, ...]) -> list[T.StructField]:
    if not argument.isTable:
        raise ValueError("a TABLE argument is needed")
    missing = [c for c in needed if c not in argument.dataType.names]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return [argument.dataType[c] for c in needed]


@udtf
class PackBatches:
    """pack_batches(TABLE(rows: grp, ord, size), most, characters): grp, ord, batch, rows packed greedily in the order of ord."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, most: AnalyzeArgument, characters: AnalyzeArgument) -> AnalyzeResult:
        group, order, _ = _table(rows, ("grp", "ord", "size"))
        return AnalyzeResult(T.StructType([group, order, T.StructField("batch", T.LongType())]), partitionBy=[PartitioningColumn("grp")], orderBy=[OrderingColumn("ord")])

    def __init__(self):
        self.items = self.total = self.batch = 0

    def eval(self, row, most: int, characters: int):
        size = row["size"] or 0
        if self.items and (self.items >= most or self.total + size > characters):
            self.items, self.total, self.batch = 0, 0, self.batch + 1
        self.items, self.total = self.items + 1, self.total + size
        yield row["grp"], row["ord"], self.batch


@udtf
class ParsePaper:
    """parse_paper(TABLE(tagged lines)): paper_id, section_no, section_type, block_type (null for a section), question_number,
    option_label, text, page_number, seq: the events of a paper's lines."""

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        paper, page, _, _ = _table(lines, ("paper_id", "page_number", "line_no", "bits"))
        kinds = {"section_no": T.IntegerType(), "section_type": T.StringType(), "block_type": T.StringType(), "question_number": T.IntegerType(), "option_label": T.StringType(), "text": T.StringType(), "page_number": page.dataType, "seq": T.IntegerType()}
        return AnalyzeResult(T.StructType([paper, *(T.StructField(n, k) for n, k in kinds.items())]), partitionBy=[PartitioningColumn("paper_id")], orderBy=[OrderingColumn("page_number"), OrderingColumn("line_no")])

    def __init__(self):
        self.lines, self.kind = [], None

    def eval(self, line):
        self.kind = self.kind or namedtuple("line", line.__fields__)
        self.lines.append(self.kind._make(line))

    def terminate(self):
        for i, (number, kind, _, block, question, label, text, page) in enumerate(G.Walk(self.lines).run()):
            yield self.lines[0].paper_id, number, kind, block, question, label, text, page, i


def register(spark: SparkSession) -> None:
    """The functions for this session's SQL."""
    for signature, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("pack_batches", PackBatches)
    spark.udtf.register("parse_paper", ParsePaper)
