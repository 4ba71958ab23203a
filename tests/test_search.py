"""The index of trigrams against a scan, and what its plans read."""

import random
import re
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.operators import search as X


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["The", "ÉTÉ", "été", "aaaa", "aaab", "x\ny", "世界和平", "🙂🙂🙂", "end."]
    rows = [(i, "".join(rng.choice([*words, " "]) for _ in range(rng.randrange(12))), rng.choice([None, "", "Theatre", "ABCABC"]), rng.randrange(4)) for i in range(300)]
    rows += [(300, None, None, None), (301, "", "aa", 1), (302, "needle " + "long text " * 40_000, None, 2)]
    path = str(tmp_path_factory.mktemp("index"))
    X.SHARD, before = 64, X.SHARD
    X.build(spark.createDataFrame(rows, "id long, a string, b string, page int").repartition(5, "id"), ["a", "b"], path)
    yield rows, path
    X.SHARD = before


@pytest.mark.parametrize("fold", ["ascii", "lower"])
def test_same_as_a_scan(spark, index, fold):
    rows, path = index
    lower = (lambda t: t.lower()) if fold == "lower" else (lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t))
    found, want = [], set()
    for i, query in enumerate((" THE ", "ÉTÉ", "aaaab", "x\ny", "世界和", "nowhere", "ab", "2", " ", "text long text")):
        needle, how = lower(query.strip()), ("text", "integer")[i % 2]
        want |= {(query, r) for r, a, b, page in rows if (r % 2 == 0 or i % 3) and (not needle or any(t and needle in lower(t) for t in (a, b)) or str(page) == needle)}
        found.append(X.found(spark, path, fold, query, ["a", "b"], {"page": how}, None if i % 3 else F.col("id") % 2 == 0).select(F.lit(query).alias("query"), "id"))
    got = [(r.query, r.id) for r in reduce(DataFrame.union, found).collect()]
    assert len(got) == len(want) and set(got) == want


def test_only_postings_of_the_needle_are_read(spark, index):
    plan = X.postings(spark, index[1], "lower", ["the", "aaa"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*fold.*lower.*bucket.* IN \(", plan) and re.search(r"PushedFilters: \[In\(gram", plan)


def test_shuffled_hits(spark, index, monkeypatch):
    want = sorted(r.id for r in X.found(spark, index[1], "ascii", "the", ["a", "b"]).collect())
    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    assert want and sorted(r.id for r in X.found(spark, index[1], "ascii", "the", ["a", "b"]).collect()) == want


def test_only_asked_foldings_are_indexed(spark, tmp_path):
    blocks = spark.createDataFrame([(1, "Ärger ABC"), (2, "other")], "id long, t string")
    X.build(blocks, ["t"], str(tmp_path / "one"), ("lower",))
    assert sorted(p.name for p in (tmp_path / "one" / "postings").glob("fold=*")) == ["fold=lower"]
    assert [r.id for r in X.found(spark, str(tmp_path / "one"), "lower", "ärger", ["t"]).collect()] == [1]
