"""Repeated runs of lines, found by prefix doubling over line ids; later copies are deleted.

A corpus is the sequence of its lines in order of document and place; a line's id is the rank of its text among the repeated
lines. Prefix doubling ranks the runs of 1, 2, 4, ... lines that begin at each place: the pair of ranks of a run's two halves
is sorted with all other pairs (a distributed sort of the distinct pairs) and its place in that order is the run's rank, as in
the construction of a suffix array. Places whose run occurs once drop out. All suffixes that share at least n lines form one
longest-common-prefix interval; it is named by the ranks of the two overlapping power-of-two runs that cover its n lines.

A repeated run counts if it has at least `least_words` words. The interval is looked up for the shortest run of enough words
that begins at each line, and that ends at it; each line of a run that is not its interval's first member is deleted. The
union of these runs is the union of the maximal repeated runs: a line in the middle of a longer one lies in the run that
begins at its first line or in the run that ends at the line itself. Since a run needs at most `least_words` lines, the
doubling ends after log2(least_words) rounds.

Lines are cut at \\n and compared without white space at their ends; lines without words belong to no run and stay, but a
document of which every line with words is deleted becomes empty. Null text stays null. Rows with equal id and text count
as one document and have the same result; equal ids with other texts are ordered by a hash of the text, null ids come first.
In a run that repeats itself (the same line many times) the first line stays. Texts of any length are taken whole. Other
columns are kept unchanged, whatever their names, but for "lines before" and "lines deleted", which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import small, stored

LEAST_WORDS = 10
DOC = ["id", "h1", "h2"]


def _keys(key: str, text: str) -> list:
    return [F.col(key).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, h1, h2, s (place among the lines with words), line (place among all), a and b (hashes of the line), n (words)."""
    rows = df.where(F.col(text).isNotNull()).select(*_keys(key, text), F.col(text).alias("t"))
    worded = F.expr("filter(transform(split(t, '\n'), (l, i) -> struct(regexp_replace(l, '^[\\\\x20\\\\x09-\\\\x0D]+|[\\\\x20\\\\x09-\\\\x0D]+$', '') AS l, i AS i)), x -> x.l <> '')")
    cut = rows.select(*DOC, F.posexplode_outer(worded).alias("s", "x")).where("s IS NOT NULL")
    return cut.select(*DOC, "s", F.col("x.i").alias("line"), F.xxhash64("x.l").alias("a"), F.xxhash64(F.lit(1), "x.l").alias("b"), F.size(F.split("x.l", r"[\x20\x09-\x0D]+")).alias("n"))


def _ranked(places: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that at least two rows have, with their rank in sorted order."""
    repeated = places.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1").select(*keys)
    return stored(repeated.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def doubled(df: DataFrame, longest: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Places of repeated lines: id, h1, h2, s, line, n, names; names[k] is the rank of the run of 2**k lines, null if it occurs once."""
    lines = stored(_lines(df, key, text), "lines")
    ranks = _ranked(lines, ["a", "b"])
    places = lines.join(ranks, ["a", "b"]).select(*DOC, "s", "line", "n", F.array("rank").alias("names")).distinct()
    places = stored(places, "places")
    k = 0
    while 2 ** (k + 1) <= longest:
        step = 2**k
        over = f"OVER (PARTITION BY id, h1, h2 ORDER BY s)"
        halves = places.selectExpr("*", f"names[{k}] AS left", f"CASE WHEN lead(s, {step}) {over} = s + {step} THEN lead(names[{k}], {step}) {over} END AS right")
        halves = stored(halves, "halves")
        ranks = _ranked(halves.where("left IS NOT NULL AND right IS NOT NULL"), ["left", "right"])
        if ranks.isEmpty():
            break
        places = stored(halves.join(ranks, ["left", "right"], "left").select(*DOC, "s", "line", "n", F.concat("names", F.array("rank")).alias("names")), "places")
        k += 1
    return places


def deleted_lines(df: DataFrame, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct id, h1, h2, line of the lines in later copies of repeated runs."""
    places = doubled(df, least_words, key, text)
    near = f"collect_list(struct(s, n, line, names)) OVER (PARTITION BY id, h1, h2 ORDER BY s ROWS BETWEEN CURRENT ROW AND {least_words - 1} FOLLOWING)"
    behind = f"collect_list(struct(s, n, line, names)) OVER (PARTITION BY id, h1, h2 ORDER BY s ROWS BETWEEN {least_words - 1} PRECEDING AND CURRENT ROW)"
    seen = places.selectExpr(*DOC, "s", f"{near} AS after", f"reverse({behind}) AS before")
    # Lines that the shortest run of enough words takes, in both directions; -1 if the place's neighbours are not repeated lines.
    need = """aggregate({way}, struct(0 AS words, 0 AS taken, true AS open), (acc, x) ->
        CASE WHEN acc.words >= {least} OR NOT acc.open THEN acc
        WHEN abs(x.s - s) <> acc.taken THEN struct(acc.words AS words, acc.taken AS taken, false AS open)
        ELSE struct(acc.words + x.n AS words, acc.taken + 1 AS taken, true AS open) END,
        acc -> CASE WHEN acc.words >= {least} THEN acc.taken ELSE -1 END)"""
    sized = seen.selectExpr("*", need.format(way="after", least=least_words) + " AS from_here", need.format(way="before", least=least_words) + " AS to_here")
    runs = sized.selectExpr(*DOC, "explode(array(slice(after, 1, greatest(from_here, 0)), reverse(slice(before, 1, greatest(to_here, 0))))) AS run").where("size(run) > 0")
    runs = runs.selectExpr(*DOC, "run[0].s AS s", "size(run) AS size", "transform(run, x -> x.line) AS lines", "CAST(floor(log2(size(run))) AS INT) AS k", "run").selectExpr(
        *DOC, "s", "size", "lines", "run[0].names[k] AS left", "run[CAST(size - pow(2, k) AS INT)].names[k] AS right"
    )
    runs = stored(runs.where("left IS NOT NULL AND right IS NOT NULL").distinct(), "runs")
    first = runs.groupBy("size", "left", "right").agg(F.min(F.struct(*DOC, "s")).alias("first"), F.max(F.struct(*DOC, "s")).alias("last")).where("first <> last").drop("last")
    later = runs.join(small(stored(first, "intervals")), ["size", "left", "right"]).where("NOT (struct(id, h1, h2, s) <=> first)")
    return later.select(*DOC, F.explode("lines").alias("line")).distinct()


def without_repeats(df: DataFrame, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with later copies deleted from its text; columns "lines before" and "lines deleted" are added."""
    gone = deleted_lines(df, least_words, key, text).groupBy(*DOC).agg(F.collect_list("line").alias("gone"))
    gone = stored(gone, "deleted")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in (text, "lines before", "lines deleted"))).alias("row"), F.col(text).alias("t"), *_keys(key, text)).alias("r")
    both = rows.join(gone.alias("g"), F.expr("r.id <=> g.id AND r.h1 = g.h1 AND r.h2 = g.h2"), "left")
    rest = "array_join(filter(split(t, '\n'), (l, i) -> NOT array_contains(gone, i)), '\n')"
    new = F.expr(f"CASE WHEN gone IS NULL THEN t WHEN {rest} RLIKE '[^\\\\x20\\\\x09-\\\\x0D]' THEN {rest} ELSE '' END")
    return both.select(
        *(new.alias(text) if c == text else F.col(f"row.`{c}`") for c in df.columns if c not in ("lines before", "lines deleted")),
        F.expr("CAST(coalesce(size(split(t, '\n')), 0) AS LONG)").alias("lines before"), F.expr("CAST(coalesce(size(gone), 0) AS LONG)").alias("lines deleted"),
    )
