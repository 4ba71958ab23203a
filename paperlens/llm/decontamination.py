"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A benchmark window is 10 consecutive words of an item; an item of fewer words is one window. Both sides hash their word
k-grams and keep the smallest hash of every w neighbouring ones, with k + w - 1 the window's length: any shared window
then shares a kept fingerprint at the same offset. Documents that hold a fingerprint of the benchmark are found by a join
on fingerprints; in these alone each hit is extended to the windows around it, which are compared word for word.
Windows of fewer than 10 words use k = their length and w = 1. The documents are read once for all lengths that occur in
the benchmark.

Words are runs of digits, a-z (A-Z lower-cased) and characters from U+0080. Null text has no words: nothing is hit, and a
null item has no windows. Repeated rows and repeated ids give one row each; repeated item ids count once. An empty
benchmark leaves every document clean. Texts of any length are taken whole. contamination() carries no other columns over,
clean() all of them unchanged, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import ascii_lower, small, stored

WINDOW, NEIGHBOURS = 10, 5
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# Arrays are exploded by the outer form: for the inner one the optimiser adds a filter on the array's size and moves it below
# the projections, where the array would be computed again inside each lambda. Null rows fall out in the joins.


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BREAKS), lambda x: x != "")


def _grams(words: str, k: int) -> Column:
    """Hashes of the k-grams of an array column; empty if it is shorter."""
    return F.expr(f"CASE WHEN size({words}) >= {k} THEN transform(sequence(1, size({words}) - {k - 1}), i -> xxhash64(slice({words}, i, {k}))) ELSE array() END")


def _kept(grams: str, w: int) -> Column:
    """The smallest of every w neighbouring hashes, each value once."""
    return F.expr(f"CASE WHEN size({grams}) >= {w} THEN array_distinct(transform(sequence(1, size({grams}) - {w - 1}), i -> array_min(slice({grams}, i, {w})))) ELSE array() END")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with equal ids and texts share a key; id, t, h1, h2."""
    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit(1), "t")})


def window_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (id, h1, h2, first word, length, item) of benchmark windows in documents. docs: id, t, h1, h2; items: item_id, words."""
    lengths = sorted(r.n for r in items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).where("n > 0").distinct().collect())  # at most WINDOW
    if not lengths:
        return docs.select("id", "h1", "h2", F.lit(0).alias("first"), F.lit(0).alias("length"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")).limit(0)
    neighbours = {n: NEIGHBOURS if n == WINDOW else 1 for n in lengths}

    def with_grams(rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("grams", _grams("words", n - neighbours[n] + 1))

    def of_length(n: int) -> DataFrame:
        """hash, d, window, item_id: a row for each kept k-gram of an item and each window around it, which begins d words before the k-gram."""
        own = with_grams(items.where(f"least(size(words), {WINDOW}) = {n}"), n).withColumn("kept", _kept("grams", neighbours[n]))
        own = own.select("item_id", "words", F.posexplode_outer("grams").alias("q", "hash"), "kept").where("array_contains(kept, hash)")
        own = own.select("item_id", "words", "q", "hash", F.explode(F.expr(f"sequence(0, {neighbours[n] - 1})")).alias("d")).where(f"q >= d AND q - d + {n} <= size(words)")
        return own.select("hash", "d", F.lit(n).alias("length"), F.expr(f"array_join(slice(words, q - d + 1, {n}), ' ')").alias("window"), "item_id").distinct()

    own = stored(_union(of_length(n) for n in lengths), "windows")
    few = small(stored(own.select("hash").distinct(), "prints"))
    marks = docs.withColumn("words", words_of(F.col("t"))).withColumns({f"grams{n}": _grams("words", n - neighbours[n] + 1) for n in lengths})
    marks = marks.withColumn("kept", F.array_distinct(F.concat(*(_kept(f"grams{n}", neighbours[n]) if neighbours[n] > 1 else F.col(f"grams{n}") for n in lengths))))
    marked = marks.select("id", "h1", "h2", F.explode_outer("kept").alias("hash")).join(few, "hash", "left_semi").select("id", "h1", "h2").distinct()
    marked = stored(marked, "marked")
    same = lambda other: F.expr(f"d.id <=> {other}.id AND d.h1 = {other}.h1 AND d.h2 = {other}.h2")
    some = docs.alias("d").join(small(marked).alias("m"), same("m"), "left_semi").select("id", "h1", "h2", words_of(F.col("t")).alias("words"))
    some = stored(some, "suspects")

    def hits_of(n: int) -> DataFrame:
        # Only ids, places and hashes meet the fingerprints; what is left of a text comes back to its words as one list.
        at = with_grams(some, n).select("id", "h1", "h2", F.posexplode_outer("grams").alias("p", "hash")).join(few, "hash", "left_semi")
        at = at.groupBy("id", "h1", "h2").agg(F.collect_set(F.struct("p", "hash")).alias("places"))
        at = some.alias("d").join(at.alias("a"), same("a")).select("d.*", F.explode("places").alias("place")).select("id", "h1", "h2", "words", "place.*")
        at = at.select("id", "h1", "h2", "hash", "p", "words", F.explode(F.expr(f"sequence(0, {neighbours[n] - 1})")).alias("d")).where(f"p >= d AND p - d + {n} <= size(words)")
        return at.select("id", "h1", "h2", "hash", "d", F.lit(n).alias("length"), (F.col("p") - F.col("d")).alias("first"), F.expr(f"array_join(slice(words, p - d + 1, {n}), ' ')").alias("window"))

    return _union(hits_of(n) for n in lengths).join(small(own), ["hash", "d", "length", "window"]).select("id", "h1", "h2", "first", "length", "item_id").distinct()


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _items(benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    return stored(benchmark.select(F.col(item).alias("item_id"), words_of(F.col(item_text)).alias("words")).where("size(words) > 0"), "items")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark window."""
    bad = stored(window_hits(_keyed(docs, key, text).where("t IS NOT NULL"), _items(benchmark, item, item_text)).select("id", "h1", "h2").distinct(), "contaminated")
    own = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")).alias("d")
    same = F.expr("d.id <=> b.id AND d.h1 = b.h1 AND d.h2 = b.h2")
    return own.join(small(bad).alias("b"), same, "left_anti").select("row.*")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs."""
    items = _items(benchmark, item, item_text)
    rows = _keyed(docs, key, text)
    hits = stored(window_hits(rows.where("t IS NOT NULL"), items), "hits")
    per_first = hits.groupBy("id", "h1", "h2", "first").agg((F.col("first") + F.max("length")).alias("end"))
    before = F.expr("max(end) OVER (PARTITION BY id, h1, h2 ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    covered = per_first.withColumn("before", before).groupBy("id", "h1", "h2").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("first", F.coalesce("before", "first")))).alias("n_hit"))
    named = hits.select("id", "h1", "h2", F.col("item_id").cast("string").alias("item")).distinct().groupBy("id", "h1", "h2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    named = named.select("id", "h1", "h2", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    per_doc = covered.alias("c").join(named.alias("n"), F.expr("c.id <=> n.id AND c.h1 = n.h1 AND c.h2 = n.h2")).select("c.id", "c.h1", "c.h2", "n_hit", "n_items", "items_sha256")
    per_doc = stored(per_doc, "contaminated")
    counted = rows.withColumn("n_words", F.coalesce(F.size(words_of(F.col("t"))), F.lit(0)).cast("long")).drop("t")
    both = counted.alias("r").join(small(per_doc).alias("c"), F.expr("r.id <=> c.id AND r.h1 = c.h1 AND r.h2 = c.h2"), "left")
    return both.select(
        F.col("r.id").alias(key),
        F.when(F.col("n_words") > 0, F.col("n_words")).otherwise(0).cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
