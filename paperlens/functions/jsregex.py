"""White space and string length as JavaScript defines them; Java's \\s is ASCII and its trim() strips U+0020 alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of JavaScript's \s.
SPACES = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: For Java's regex, whose classes ask one member after another: two ranges first tell all characters that are none of these.
WS = rf"[\x00-\x20\u00a0-\uffff&&[{SPACES}]]"
#: The same for Python's re; and, for Java's, all but the plain blank.
PLAIN_WS = f"[{SPACES}]"
ODD_WS = rf"[\x00-\x1f\u00a0-\uffff&&[{SPACES}]]"
#: ASCII word boundaries, before and after a word character.
START, END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def squeeze(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(c, WS + "+", by)


def length(c: Column) -> Column:
    """UTF-16 units: characters beyond U+FFFF count twice."""
    return F.char_length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def named(value: Column, use) -> Column:
    """use(value), with the value made once however often use() names it: a lambda over one element."""
    return F.transform(F.array(value), use)[0]
