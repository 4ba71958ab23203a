"""The pipeline's stages on planted cases, each held against what brute force says of its own input."""

import random

import corpus_pipeline as P
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_line_dedup import brute as deleted
from tests.llm.test_near_dedup import brute as groups

TINY = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    random.seed(9)
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    passage = " ".join(f"passage{i}" for i in range(60))
    words = " ".join(f"plain{i}" for i in range(80)).split()
    planted = [(5000, f"first words here\n{passage}\nand an end"), (5001, f"other words there\n{passage}"), (5002, " ".join(words)), (5003, " ".join([*words[:40], "changed", *words[41:]])), (5004, "prefix " + bench[0][1]), (5005, own[0][1])]
    extra = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in planted], docs.schema)
    frame = docs.unionByName(extra)
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    assert [f for _, f in P.STAGES] == [P.good_quality, P.fresh_lines, P.one_of_each, P.clean_of_benchmark, P.encoded]
    good = P.good_quality(spark, frame, TINY)
    assert good.columns == docs.columns and {i for i, _ in planted} <= {r.doc_id for r in good.collect()}

    before = texts(frame)
    after, gone = P.fresh_lines(spark, frame, TINY), deleted(before, 10)
    want = []
    for i, t in before:
        rest = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        if not gone[i] or rest.strip():
            want.append((i, rest))
    assert texts(after) == sorted(want) and after.schema.names == docs.columns
    left = dict(texts(after))
    assert passage in left[5000] and passage not in left[5001] and 5005 not in left
    assert all(r.n_chars == len(r.text) for r in after.collect())

    kept = P.one_of_each(spark, frame, TINY)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, _, k in groups(before, 5, 80) if k)
    assert 5002 in {r.doc_id for r in kept.collect()} and 5003 not in {r.doc_id for r in kept.collect()}

    clean = P.clean_of_benchmark(spark, frame, TINY)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, *_, bad in contaminated(before, bench) if not bad)

    result = P.run(spark, TINY)
    assert result.count() > 0 and set(result.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_ids_of_any_type_and_nameless_rows(spark):
    """Long ids that share a prefix, negative ones, the same choice with and without nameless rows, a table without n_chars."""
    x, y = " ".join(f"one{i}" for i in range(30)), " ".join(f"two{i}" for i in range(30))
    near = x.replace("one29", "end")

    def kept(rows, kind):
        docs = spark.createDataFrame([(i, t, "other") for i, t in rows], f"doc_id {kind}, text string, name string")
        return sorted(((r.doc_id, r.text) for r in P.one_of_each(spark, docs, TINY).collect()), key=str)

    for nameless in ([], [(None, "nobody has words like these here")]):
        assert kept([("alpha-corpus/2024/00000001", x), ("alpha-corpus/2024/00000002", y), ("z", x), ("0", y), *nameless], "string") == sorted([("alpha-corpus/2024/00000001", x), ("0", y), *nameless], key=str)
        assert kept([(-5, x), (-7, x), (3, y), (20, near), *nameless], "long") == sorted([(-7, x), (3, y), *nameless], key=str)
        assert kept([(4, x), (4, y), (9, y), *nameless], "long") == sorted([(4, x), (4, y), *nameless], key=str)
    assert kept([(None, x), (None, x), (None, near), (8, y), (None, y)], "long") in ([(8, y), (None, x)], [(8, y), (None, near)])

    docs = spark.createDataFrame([(1, f"first\n{x}"), (2, f"second\n{x}")], "doc_id long, text string")
    assert sorted(tuple(r) for r in P.fresh_lines(spark, docs, TINY).collect()) == [(1, f"first\n{x}"), (2, "second")]


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    want = sorted(tuple(r) for r in P.one_of_each(spark, docs, TINY).collect())
    monkeypatch.setattr("paperlens.llm.common.BROADCAST_ROWS", 0)
    monkeypatch.setattr("paperlens.llm.near_dedup.HUB_DOCS", 2)
    assert sorted(tuple(r) for r in P.one_of_each(spark, docs, TINY).collect()) == want
