"""URL verdicts: fixed host and path rules first, then association rules that FP-growth mines from labelled URLs.

A URL becomes a set of tokens: the host, its labels and their hyphen-free parts, path segments that hold no digit, file
endings and query keys. Labelled URLs with their class as one more token go through Spark's FP-growth; rules that conclude
"block" and reach the least support, confidence and lift remain, and of these the ones that no shorter rule implies.
Mining takes all tokens of a URL. Tokens below the least support are in no rule and go first; of tokens that the same labelled
URLs hold, one stands for all while mining, since no such two are in a rule that no shorter one implies, and its rules are
then written out for each of them.
Matching uses an inverted index: each rule is listed under its rarest token alone, a URL meets the rules listed under its
tokens, and a rule fires if the URL holds all of its tokens. A URL with a fired rule is blocked, any other allowed.

Host and path of a null URL or one without "://" are empty: no rule fits, the verdict is allow. Repeated rows and ids give
one row each. Without labelled URLs no rule is mined. Clashing columns are not carried over.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import ascii_lower, stored

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Least share of labelled URLs that a combination must hold, least share of blocked ones among them, and least lift.
SUPPORT, CONFIDENCE, LIFT = 0.002, 0.6, 1.2
BROADCAST_RULES = 10_000
BLOCK = "class=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule (as host and path) and verdict of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens(url: str = "url", host: str = "host", path: str = "path") -> Column:
    """Distinct tokens of a URL whose host and path are given as columns."""
    return F.expr(
        f"""array_distinct(filter(concat(
            array(concat('host=', {host})),
            transform(split({host}, '[.]'), x -> concat('label=', x)),
            transform(filter(split({host}, '[.-]'), x -> x <> ''), x -> concat('word=', x)),
            transform(filter(split({path}, '/'), x -> NOT x RLIKE '[0-9]'), x -> concat('path=', x)),
            transform(regexp_extract_all({path}, '[.]([a-z]+)$', 1), x -> concat('ending=', x)),
            transform(regexp_extract_all(coalesce({url}, ''), '[?&]([^=&#]+)=', 1), x -> concat('query=', x))
        ), x -> NOT x RLIKE '=$'))"""
    )


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """Rules (rule long, antecedent, size, rarest, confidence, lift, support). labelled: tokens array, blocked boolean."""
    rows = stored(labelled.select(F.monotonically_increasing_id().alias("n"), "tokens", "blocked"), "labelled")
    listed = rows.select("n", "blocked", F.explode_outer("tokens").alias("token"))
    held = listed.where("token IS NOT NULL").groupBy("token").agg(
        F.count("*").alias("freq"), F.sum(F.xxhash64("n").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "n")).alias("s2")
    )
    singles = stored(held.where(F.col("freq") >= F.lit(math.ceil(support * rows.count()))), "tokens")
    alike = stored(singles.groupBy("freq", "s1", "s2").agg(F.min("token").alias("first"), F.array_sort(F.collect_list("token")).alias("members")), "alike")
    stands = alike.select(F.col("first").alias("token"))
    stands = F.broadcast(stands) if alike.count() <= BROADCAST_RULES else stands
    kept = listed.join(stands.withColumn("item", F.col("token")), "token", "left").groupBy("n").agg(F.collect_list("item").alias("items"), F.first("blocked").alias("blocked"))
    sets = kept.select(F.concat("items", F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(sets)
    found = model.associationRules.where(F.array_contains("consequent", BLOCK)).where(F.col("lift") >= lift)
    found = stored(found.select(F.monotonically_increasing_id().alias("n"), "antecedent", "confidence", "lift", "support"), "found")
    choices = found.select("n", F.explode("antecedent").alias("first")).join(alike.select("first", "members"), "first").groupBy("n").agg(F.collect_list("members").alias("choices"))
    every = "aggregate(choices, array(cast(array() AS array<string>)), (all, c) -> flatten(transform(all, p -> transform(c, m -> concat(p, array(m))))))"
    found = found.drop("antecedent").join(choices, "n").select("confidence", "lift", "support", F.explode(F.expr(every)).alias("antecedent"))
    rules = stored(found.select(F.xxhash64(F.array_sort("antecedent")).alias("rule"), F.array_sort("antecedent").alias("antecedent"), F.size("antecedent").alias("size"), "confidence", "lift", "support"), "rules")
    # A rule is implied by a shorter one: leave one token out and look for the rest; applied to all lengths, chains fall too.
    shorter = rules.select("rule", F.explode(F.expr("transform(sequence(0, size - 1), i -> xxhash64(filter(antecedent, (x, k) -> k <> i)))")).alias("part")).join(
        rules.select(F.col("rule").alias("part")), "part", "left_semi"
    )
    least = rules.join(shorter.select("rule").distinct(), "rule", "left_anti")
    rarest = least.select("rule", F.explode("antecedent").alias("token")).join(singles.select("token", "freq"), "token").groupBy("rule").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest"))
    return least.join(rarest, "rule")


def fired(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct keys of pages (key, tokens) that hold all tokens of a rule. rules: a stored table."""
    few = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    listed = pages.select("key", "tokens", F.explode("tokens").alias("rarest"))
    met = listed.join(few.select("rarest", "antecedent", "size"), "rarest")
    return met.where("size(array_intersect(tokens, antecedent)) = size").select("key").distinct()


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. A page's label is that of the document whose number ends its path:
    blocked if of low quality or toxic."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "fixed": verdict, "tokens": tokens()})
    own = rows.select("tokens", F.regexp_extract("path", r"/([0-9]{1,18})(?:[.][a-z]+|/)?$", 1).try_cast("long").alias("doc_id"))
    classes = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1")).alias("blocked"))
    mined = stored(mine(own.join(classes, "doc_id"), support, confidence), "rules")
    # URLs with equal tokens match alike: match each set of tokens once.
    sets = rows.where("fixed IS NULL").select("tokens").distinct().select(F.xxhash64("tokens", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), "tokens").alias("h2"), "tokens")
    hit = fired(sets.select(F.struct("h1", "h2").alias("key"), "tokens"), mined).select("key.h1", "key.h2", F.lit(True).alias("hit"))
    keyed = rows.withColumns({"h1": F.xxhash64("tokens", F.lit(1)), "h2": F.xxhash64(F.lit(2), "tokens")})
    few = stored(hit, "fired")
    few = F.broadcast(few) if few.count() <= BROADCAST_RULES else few
    return keyed.join(few, ["h1", "h2"], "left").select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))
