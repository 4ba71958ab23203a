"""Text functions: normalisation, hashes, sentences, paragraphs, words, names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperlens.functions.jsregex import END, START, WS, named, squeeze, trim


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode form NFKC, which Spark has no function for; ASCII texts pass unchanged."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def normalize_for_hash(c: Column) -> Column:
    """ASCII texts, which NFKC leaves alone, are not sent to Python."""
    formed = F.coalesce(nfkc(F.when(F.octet_length(c) != F.char_length(c), c)), c)
    return F.lower(trim(F.translate(squeeze(formed), "“”‘’", "\"\"''")))


def text_hash(c: Column) -> Column:
    """SHA-256 of the normalised text: equal for texts that differ in case, white space or quotes alone."""
    return F.sha2(normalize_for_hash(c), 256)


def compact(c: Column) -> Column:
    """Inline white space to single blanks, lines trimmed, at most one blank line in a row."""
    out = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), " ", " ")
    out = trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n"))
    return trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def _pieces(text: Column, pattern: str) -> Column:
    def cut(t: Column) -> Column:
        return named(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.filter(F.array(t), lambda x: x != "")).otherwise(F.filter(F.transform(found, lambda x: trim(x)), lambda x: x != "")))

    return named(text, cut)


def sentences_en(c: Column) -> Column:
    """Sentences ended by . ! ? with closing quotes or brackets, and a tail; the whole text if nothing matches."""
    return _pieces(squeeze(compact(c)), r"""[^.!?]+[.!?]+(?:["')\]]+)?|[^.!?]+\z""")


def sentences_zh(c: Column) -> Column:
    return _pieces(squeeze(compact(c), ""), "[^。！？；]+[。！？；]+|[^。！？；]+\\z")


def explicit_paragraphs(c: Column) -> Column:
    """Blocks between blank lines; else lines of 20 characters or more if there are several; else the text as one."""
    def cut(text: Column) -> Column:
        blocks = F.filter(F.transform(F.split(text, rf"\n{WS}*\n", -1), lambda x: trim(x)), lambda x: x != "")
        lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: trim(x)), lambda x: F.char_length(x) >= 20)
        single = F.filter(F.array(F.regexp_replace(text, "\n+", " ")), lambda x: x != "")
        return named(F.struct(blocks.alias("blocks"), lines.alias("lines")), lambda p: F.when(F.size(p.blocks) > 1, p.blocks).when(F.size(p.lines) > 1, p.lines).otherwise(single))

    return named(compact(c), cut)


def pack_sentences(sentences: Column, most: int = 4, characters: int = 620) -> Column:
    """Greedy packs of at most `most` sentences and `characters` characters, joined by blanks (which do not count)."""
    start = F.struct(F.array().cast("array<string>").alias("packs"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        full = (F.size(acc.open) > 0) & ((F.size(acc.open) >= most) | (acc.n + F.char_length(s) > characters))
        return F.when(full, F.struct(F.array_append(acc.packs, F.array_join(acc.open, " ")).alias("packs"), F.array(s).alias("open"), F.char_length(s).alias("n"))).otherwise(
            F.struct(acc.packs.alias("packs"), F.array_append(acc.open, s).alias("open"), (acc.n + F.char_length(s)).alias("n"))
        )

    return F.aggregate(sentences, start, add, lambda acc: F.when(F.size(acc.open) > 0, F.array_append(acc.packs, F.array_join(acc.open, " "))).otherwise(acc.packs))


def paragraphs(c: Column) -> Column:
    """Explicit paragraphs; a single one of over 620 characters and four sentences is packed into smaller ones."""
    def cut(p: Column) -> Column:
        return named(sentences_en(F.get(p, F.lit(0))), lambda s: F.when(F.size(s) > 4, pack_sentences(s)).otherwise(p))

    return named(explicit_paragraphs(c), lambda p: F.when((F.size(p) == 1) & (F.char_length(F.get(p, F.lit(0))) > 620), cut(p)).otherwise(p))


def words(c: Column) -> Column:
    """Words of letters with inner hyphens and apostrophes."""
    return F.regexp_extract_all(c, F.lit("[A-Za-z]+(?:[-'][A-Za-z]+)*"), F.lit(0))


def lookup_word(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\A['-]+|['-]+\z", "")


def context(c: Column, most: int = 220) -> Column:
    return F.substring(trim(squeeze(c)), 1, most)


def safe_name(c: Column, default: str = "paper.pdf") -> Column:
    """A file name of word characters, dots, hyphens and CJK, without outer underscores, of at most 120 characters."""
    name = F.substring(F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z_.一-鿿-]+", "_"), r"\A_+|_+\z", ""), 1, 120)
    return F.when(name == "", default).otherwise(name)


def masked(c: Column) -> Column:
    """First and last four characters of a key of over eight, else stars."""
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(F.char_length(c) <= 8, "****").otherwise(F.concat(F.substring(c, 1, 4), F.lit("****"), F.right(c, F.lit(4))))


def base_url(c: Column) -> Column:
    return F.regexp_replace(trim(c), r"/+\z", "")


def first_object(c: Column) -> Column:
    """From the first { to the last }: JSON that is wrapped in prose."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


# Words that text extraction breaks apart, and their repairs, in order.
BROKEN = (
    (r"Part\s+[1l]V", "Part IV"),
    (r"f\s+our", "four"),
    (r"fo\s+llowing", "following"),
    (r"fol\s+lowing", "following"),
    (r"follow\s+ing", "following"),
    (r"quest\s+ions", "questions"),
    (r"ques\s+tions", "questions"),
    (r"corres\s+ponding", "corresponding"),
)
CJK = r"㐀-鿿"


def normalize_extracted(c: Column) -> Column:
    """Text of a page: line ends and blanks unified, blanks between CJK characters dropped, broken words repaired."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\x00", ""), "\r\n?", "\n"), r"[ \t]+", " ")
    out = F.regexp_replace(out, rf"(?<=[{CJK}]){WS}+(?=[{CJK}，。；：？！、])", "")
    out = F.regexp_replace(out, rf"(?<=[，。；：？！、]){WS}+(?=[{CJK}])", "")
    out = F.regexp_replace(F.regexp_replace(out, rf"{WS}+\n", "\n"), r"\n{3,}", "\n\n")
    for pattern, repair in BROKEN:
        out = F.regexp_replace(out, f"(?i){START}{pattern.replace(chr(92) + 's', WS)}{END}", repair)
    return trim(out)
