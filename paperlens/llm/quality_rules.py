"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once per document: the measurements are stored beside one bit per failed rule. A policy is a
versioned set of rules, that is a mask; applying one, comparing two or asking what each rule alone removes are bitwise
operations and aggregations over the ledger, never another pass over the texts.

Words are runs without ASCII white space. Null text counts as empty: no words, and so it fails too_few_words. Texts of any
length are taken whole. Repeated rows and repeated or null ids give one row each. Clashing columns are not carried over. An
empty table gives an empty ledger, and ablations of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in the order of their bits, each a condition over the measurements.
RULES = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "odd_word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "repeated_lines": "3 * n_dup_lines > 2 * n_lines",
    "shouting": "2 * n_upper > word_chars",
    "exclaiming": "5 * n_exclaiming > n_words",
}
#: Policies by version.
POLICIES = {"base": ("too_few_words", "repeated_windows"), "v1": tuple(RULES)}
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW = 8


def _count(text: str, characters: str) -> Column:
    """How many of some single-byte characters a text holds, by what octet_length loses without them."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit(c))) for c in characters), F.lit(0)).cast("long")


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the measurements, and failures: a bit for each failed rule."""
    t = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = t.withColumns({"words": F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != ""), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    windows = split.withColumn(
        "windows", F.expr(f"CASE WHEN size(words) >= {WINDOW} THEN transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) ELSE array() END")
    )
    # Equal hashes only point to documents worth a second look; there whole windows are sorted and compared.
    suspect = windows.withColumn(
        "found",
        F.expr(
            f"""CASE WHEN size(array_distinct(windows)) < size(windows)
            THEN array_sort(transform(sequence(1, size(words) - {WINDOW - 1}), i -> struct(array_join(slice(words, i, {WINDOW}), ' ') AS w, i)))
            ELSE array() END"""
        ),
    )
    places = suspect.withColumn(
        "places", F.expr("array_sort(transform(filter(transform(found, (x, k) -> struct(x.i AS i, coalesce(get(found, k - 1).w = x.w, false) OR coalesce(get(found, k + 1).w = x.w, false) AS again)), x -> x.again), x -> x.i))")
    )
    repeated = F.expr(f"aggregate(places, struct(0L AS last, 0L AS n), (a, p) -> struct(p + {WINDOW}L AS last, a.n + p + {WINDOW}L - greatest(p, a.last) AS n), a -> a.n)")
    measured = places.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        (F.char_length("t") - _count("t", SPACES)).cast("long").alias("word_chars"),
        _count("t", SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        _count("t", "!").alias("n_exclaiming"),
    )
    bits = " | ".join(f"CASE WHEN {rule} THEN {1 << i}L ELSE 0L END" for i, rule in enumerate(RULES.values()))
    return measured.withColumn("failures", F.expr(bits)).withColumnRenamed("id", key)


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(rule) for rule in POLICIES[policy])


def passes(policy: str, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(found: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy would keep without it."""
    used = found.select(F.col("failures").bitwiseAND(F.lit(mask(policy))).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(1 << list(RULES).index(rule)).cast("long").alias("bit")) for rule in POLICIES[policy]))
    # A row a rule without documents, so that an empty table has all rules.
    none = found.sparkSession.range(1).select(F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("n"))
    each = used.unionByName(none).select("f", "n", F.explode(rules).alias("r")).select("f", "n", "r.*")
    total = lambda test: F.sum(F.when(F.expr(test), F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(total("f & bit <> 0").alias("fail"), total("f = bit").alias("fail_alone"), total("f = 0 OR f = bit").alias("kept_without"))


def judged(df: DataFrame, policy: str = "v1", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger with base_failed and the policy's verdict, kept."""
    found = ledger(df, key, text)
    return found.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), (passes("base") & passes(policy)).alias("kept"), "failures"
    )
