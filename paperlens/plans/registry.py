"""Registration of queries beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperlens.functions.jsregex import END, START, WS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: JavaScript's white space in the oracle's patterns.
SQL_SPACE = r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def rewritten_sql(value: str, steps) -> str:
    """SQL that replaces patterns (Java's, with the boundaries and white space of functions.jsregex) one after another."""
    for pattern, by in steps:
        pattern = pattern.replace(START, r"\b").replace(END, r"\b").replace(WS, SQL_SPACE).replace("\x00", r"\x00").replace("'", "''")
        value = f"regexp_replace({value}, '{pattern}', '{by.replace('$', chr(92)).replace(chr(39), chr(39) * 2)}', 'g')"
    return value
