"""Licence scans in DataFrame functions alone: normalised text against licence templates by the Dice coefficient over word bigrams.

Units of a document are its lines, its paragraphs (blocks between blank lines, where of several lines) and its whole text.
Each is normalised to lower-case words and becomes its set of word bigrams. A coefficient of at least p percent needs
set sizes within p / (200 - p) of each other, so a unit whose size fits no template is dropped before its bigrams are
listed, and a unit meets only templates within the bounds. The bigrams that remain are joined to those of the templates
(an inverted list of fixed size) and counted.

Licences of several lines or paragraphs within a longer text, and notices within a line, are found as spans: runs of words of
any place and length. Only texts that hold enough bigrams of a template are looked at. A best span begins and ends with a
bigram of the template and does not hold its first bigram again, so from each such bigram one walk goes up to its next copy,
or to where the set outgrows the bounds. A template counts as often as units match it, or as disjoint spans do, whichever is more.

Null and empty texts, and units of fewer than two words, match nothing. Texts of any length are taken whole. Repeated rows
and repeated ids give one row each. Clashing columns are not carried over. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlens.llm.common import ascii_lower, small, stored
from paperlens.llm.license_templates import TEMPLATES

PERCENT = 80
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEYS = ["id", "h1", "h2"]
#: Words that are no good anchors. The choice of anchors never changes a result.
COMMON = frozenset("a all an and any are as at be but by can for from have if in is it may not of on or other out see shall that the this to under use with you".split())


def template_bigrams(templates: dict[str, str] = TEMPLATES) -> dict[str, list[str]]:
    """Sorted distinct bigrams of each template."""
    out = {}
    for name, text in templates.items():
        words = [w for w in re.split(BREAKS, text.lower()) if w]
        out[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
    return out


def _template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = [(b, name, len(bigrams)) for name, bigrams in template_bigrams(templates).items() for b in bigrams]
    return spark.createDataFrame(rows, "bigram string, template string, t_size int")


def least_common(size: int, percent: int) -> int:
    """Least number of common bigrams with which a set can reach the threshold."""
    return -(-percent * size // (200 - percent))


def anchors(templates: dict[str, str], percent: int) -> list[str]:
    """Words of which any text with a span of one of the templates holds at least one."""
    out = set()
    for bigrams in template_bigrams(templates).values():
        left = [b.split(" ") for b in bigrams]
        for word in sorted({w for b in left for w in b}, key=lambda w: (w in COMMON, -len(w), w)):
            if len(left) < least_common(len(bigrams), percent):
                break
            out.add(word)
            left = [b for b in left if word not in b]
    return sorted(out)


def spans(df: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h1, h2 (of the text), template, n (disjoint spans at or above the threshold, at most), best (Dice of the best span)."""
    held = f"(?:\\A|{BREAKS[:-1]})(?:{'|'.join(anchors(templates, percent))})(?:\\z|{BREAKS[:-1]})"
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where(ascii_lower(F.col("t")).rlike(held))
    docs = docs.withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit(1), "t")}).distinct()
    docs = docs.withColumn("words", F.filter(F.split(ascii_lower(F.col("t")), BREAKS), lambda x: x != ""))
    # Explode keeps a value from being copied into each place that names it.
    listed = docs.select(*KEYS, F.explode(F.expr("transform(array(words), w -> CASE WHEN size(w) > 1 THEN transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i])) ELSE array() END)")).alias("b"))
    known = F.array(
        *(
            F.struct(F.lit(name).alias("template"), F.lit(len(bigrams)).alias("t_size"), F.lit(least_common(len(bigrams), percent)).alias("least"), F.array(*map(F.lit, bigrams)).alias("bigrams"))
            for name, bigrams in template_bigrams(templates).items()
        )
    )
    near = listed.select(*KEYS, "b", F.explode(F.filter(known, lambda x: F.size(F.array_intersect(x.bigrams, F.col("b"))) >= x.least)).alias("x"))
    sorted_ = near.select(*KEYS, "x", F.explode(F.expr("array(array_sort(transform(b, (g, i) -> struct(g AS g, i AS pos))))")).alias("o"))
    linked = """transform(o, (y, k) -> struct(x.template AS template, x.t_size AS t_size, y.pos AS pos, CASE WHEN k > 0 AND get(o, k - 1).g = y.g THEN get(o, k - 1).pos ELSE -1 END AS before,
        CASE WHEN get(o, k + 1).g = y.g THEN get(o, k + 1).pos END AS after, array_contains(x.bigrams, y.g) AS hit))"""
    rows = sorted_.select(*KEYS, F.explode(F.expr(linked)).alias("y")).select(*KEYS, "y.*")
    place = Window.partitionBy(*KEYS, "template", "t_size").orderBy("pos")
    rows = rows.withColumn("earlier", F.coalesce(F.sum(F.expr("int(before < 0)")).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    texts = rows.groupBy(*KEYS, "template", "t_size").agg(F.array_sort(F.collect_list(F.struct("pos", "before", "after", "earlier", "hit"))).alias("a"))
    texts = texts.select(*KEYS, "template", "t_size", "a", F.explode(F.expr("array(transform(filter(a, e -> e.before < 0), e -> e.pos))")).alias("firsts"))
    size, common = "(s.size + int(e.before < x.pos))", "(s.common + int(e.before < x.pos AND e.hit))"
    enough = f"200 * {common} >= {percent} * ({size} + t_size)"
    walk = f"""aggregate(
        slice(a, x.pos + 1, least(coalesce(x.after, size(a)), coalesce(get(firsts, x.earlier + {200 - percent} * t_size div {percent}), size(a))) - x.pos),
        named_struct('size', 0, 'common', 0, 'end', -1, 'best', 0D),
        (s, e) -> named_struct('size', {size}, 'common', {common}, 'end', CASE WHEN s.end < 0 AND {enough} THEN e.pos ELSE s.end END,
          'best', CASE WHEN {enough} THEN greatest(s.best, 2D * {common} / ({size} + t_size)) ELSE s.best END),
        s -> named_struct('end', s.end, 'start', x.pos, 'best', s.best))""".replace("x.earlier +", "int(x.earlier +").replace(f"div {percent})", f"div {percent}))")
    found = texts.select(*KEYS, "template", F.explode(F.expr(f"array(array_sort(filter(transform(filter(a, x -> x.hit), x -> {walk}), r -> r.end >= 0)))")).alias("r")).where("size(r) > 0")
    # Of spans in order of their ends each that begins behind the last one taken: so as many as there can be.
    disjoint = "aggregate(r, named_struct('last', -2, 'n', 0L), (s, y) -> CASE WHEN y.start > s.last + 1 THEN named_struct('last', y.end, 'n', s.n + 1L) ELSE s END, s -> s.n)"
    return found.select(*KEYS, "template", F.expr(disjoint).alias("n"), F.expr("array_max(transform(r, y -> y.best))").alias("best"))


def matches(df: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h1, h2 (of the text), unit, template, common, size, t_size of every unit and template at or above the threshold."""
    spark = df.sparkSession
    sizes = sorted({len(b) for b in template_bigrams(templates).values()})
    fits = " OR ".join(f"({percent} * {s} <= {200 - percent} * size AND {percent} * size <= {200 - percent} * {s})" for s in sizes)
    shortest = min(sizes) * percent // (200 - percent)
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("t IS NOT NULL").withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit(1), "t")})
    # Rows with equal ids and texts share a key: their counts are divided by how many they are, so no text is shuffled.
    rows = small(stored(docs.groupBy(*KEYS).agg(F.count("*").alias("rows")).where("rows > 1"), "repeated-rows"))
    units = docs.select(
        "id", "h1", "h2",
        F.explode(
            F.expr(
                r"""concat(
                transform(split(t, '\n'), (u, i) -> struct(concat('line ', i) AS unit, u AS u)),
                CASE WHEN t RLIKE '\n[ \t\r]*\n' THEN transform(filter(transform(split(t, '\n[ \t\r]*\n'), (u, i) -> struct(concat('paragraph ', i) AS unit, u AS u)), x -> contains(x.u, '\n')), x -> x) ELSE array() END,
                CASE WHEN contains(t, '\n') THEN array(struct('text' AS unit, t AS u)) ELSE array() END)"""
            )
        ).alias("x"),
    )
    # The optimiser may copy an expression into each place that names it, lambdas included. So words and bigrams are named by
    # lambdas over one element, and the size travels within the exploded rows, where no filter on it can move below.
    near = units.select("id", "h1", "h2", "x.unit", "x.u").where(F.char_length("u") > 2 * shortest)
    pairs = "CASE WHEN size(w) > 1 THEN array_distinct(transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))) ELSE array() END"
    fitting = f"CASE WHEN {fits.replace('size', 'size(b)')} THEN transform(b, g -> struct(g AS bigram, size(b) AS size)) ELSE array() END"
    near = near.withColumn("words", F.filter(F.split(ascii_lower(F.col("u")), BREAKS), lambda x: x != ""))
    kept = F.expr(f"flatten(transform(transform(array(words), w -> {pairs}), b -> {fitting}))")
    listed = near.select("id", "h1", "h2", "unit", F.explode_outer(kept).alias("x")).select("id", "h1", "h2", "unit", "x.bigram", "x.size")
    common = listed.join(F.broadcast(_template_table(spark, templates)), "bigram").where(f"{percent} * t_size <= {200 - percent} * size AND {percent} * size <= {200 - percent} * t_size")
    counted = common.groupBy("id", "h1", "h2", "unit", "template", "size", "t_size").agg(F.count("*").alias("common")).alias("c")
    counted = counted.join(rows.alias("m"), F.expr("c.id <=> m.id AND c.h1 = m.h1 AND c.h2 = m.h2"), "left")
    counted = counted.select("c.id", "c.h1", "c.h2", "unit", "template", "size", "t_size", F.expr("common div coalesce(rows, 1)").alias("common"))
    return counted.where(f"200 * common >= {percent} * (size + t_size)")


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT, key: str = "doc_id", text: str = "text", within: bool = False) -> DataFrame:
    """One row per row of df: key, n_matches (units and templates), licenses (sorted, comma-joined; null if none), best_dice.
    within: spans count too."""
    found = matches(df, templates, percent, key, text).groupBy(*KEYS, "template").agg(F.count("*").alias("n"), F.max(F.expr("2D * common / (size + t_size)")).alias("best"))
    if within:
        found = found.unionByName(spans(df, templates, percent, key, text)).groupBy(*KEYS, "template").agg(F.max("n").alias("n"), F.max("best").alias("best"))
    per_doc = found.groupBy(*KEYS).agg(F.sum("n").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("template")), ",").alias("licenses"), F.max("best").alias("best_dice"))
    rows = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    per_doc = stored(per_doc, "licences")
    both = rows.alias("r").join(per_doc.alias("m"), F.expr("r.id <=> m.id AND r.h1 = m.h1 AND r.h2 = m.h2"), "left")
    return both.select(F.col("r.id").alias(key), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), "licenses", F.round(F.coalesce("best_dice", F.lit(0.0)), 6).alias("best_dice"))
