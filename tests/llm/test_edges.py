"""Every operator and every pipeline stage on clashing names, nulls, repeated rows, a very long text and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from paperlens.llm import decontamination, license_scan, line_dedup, near_dedup, quality_classifier, quality_rules, sentencepiece_codec, token_counts, url_filters, warc

TINY = "/root/testdata/sf0.001"
CLASHING = ["_id", "_h1", "_h2", "id", "h1", "h2", "t", "row", "key", "k", "name", "predicted", "held_out", "score", "kept", "gone", "n", "hub", "words", "component_id", "n_tokens", "n_hit", "failures", "refers_to", "payload", "text to score"]
LONG = " ".join(f"word{i % 5000} Another{i % 77}." for i in range(60_000))  # over 1 MB
ROWS = [(1, "one line of a text with quite a few words in it", "en", "a", 3), (1, "one line of a text with quite a few words in it", "en", "a", 3), (None, "no id " * 12, "en", None, None), (None, None, None, None, None), (4, "", "de", "a", 0), (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)), (7, "  \n \n", "en", "b", 5)]


def documents(spark, rows=ROWS):
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return plain.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING))


def html(spark, rows=ROWS):
    return documents(spark, rows).select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.org/"), F.col("text")).alias("url"), F.col("text").alias("html"), *(f"`{c}`" for c in CLASHING if c not in ("page_id", "url")))


def labels(spark):
    return spark.read.parquet(f"{TINY}/labels.parquet")


def benchmark(spark):
    return spark.createDataFrame([(1, "Another1. word2 another2"), (2, None)], "item_id long, text string")


MODEL, TOKENIZER = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
OPERATORS = {
    "op1": lambda s, r: sentencepiece_codec.round_trip(documents(s, r), MODEL),
    "op2": lambda s, r: url_filters.judged(html(s, r), labels(s)),
    "op3": lambda s, r: quality_classifier.quality(documents(s, r), labels(s)),
    "op4": lambda s, r: decontamination.contamination(documents(s, r), benchmark(s)),
    "op5": lambda s, r: warc.archived(html(s, r)),
    "op6": lambda s, r: near_dedup.near_duplicates(documents(s, r)),
    "op7": lambda s, r: token_counts.token_counts(documents(s, r), TOKENIZER),
    "op8": lambda s, r: quality_rules.judged(documents(s, r)),
    "op9": lambda s, r: license_scan.scan(documents(s, r), within=True),
    "op10": lambda s, r: line_dedup.without_repeats(documents(s, r)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    got = OPERATORS[name](spark, ROWS).collect()
    key = "page_id" if "page_id" in got[0].__fields__ else "doc_id"
    assert sorted(-1 if r[key] is None else r[key] for r in got) == sorted(-1 if r[0] is None else r[0] for r in ROWS)
    assert OPERATORS[name](spark, []).count() == 0


def kept_whole(got, unless=()):
    for r in got:
        for c in CLASHING:
            assert r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}", c


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES[:-1]])
def test_stages_keep_other_columns(spark, stage):
    docs = documents(spark)
    got = stage(spark, docs, TINY)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    kept_whole(got.collect())
    assert stage(spark, documents(spark, []), TINY).count() == 0


def test_last_stage(spark):
    assert P.encoded(spark, documents(spark), TINY).count() == len(ROWS) and P.encoded(spark, documents(spark, []), TINY).count() == 0


def test_one_of_each_keeps_one_of_repeated_and_of_nameless_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(9, text), (9, text), (None, text + " more"), (None, "other " * 30), (None, "other " * 30), (12, "other " * 30), (3, None), (3, None), (None, "alone here with these very few words"), (20, "alone here with these very few words too and many others behind them")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "")[:5]) for r in P.one_of_each(spark, docs, TINY).collect())
    assert got == [(-1, "alone"), (3, ""), (9, "w0 w1"), (12, "other"), (20, "alone")]


@pytest.mark.parametrize("percent", [50, 65, 70, 95, 100])
def test_near_duplicates_at_any_threshold(spark, percent):
    from tests.llm.test_near_dedup import brute, corpus, run

    rows = corpus(percent)
    assert run(spark, rows, 3, percent) == brute(rows, 3, percent)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    from tests.llm.test_near_dedup import brute, corpus, run

    for name, value in (("HUB_DOCS", 3), ("BLOCK_DOCS", 4), ("BLOCK_ELEMENTS", 200), ("STAR_ROUNDS", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = corpus(11)
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)
