"""Packing over chunks against a plain loop; runs against a cache of versions, again and as a stream."""

import random

from pyspark.sql import functions as F

from paperlens.operators import packing as P
from paperlens.operators import translation as O


def plain(sizes, most, characters):
    out, batch, items, total = [], 0, 0, 0
    for n in sizes:
        if items and (items >= most or total + n > characters):
            batch, items, total = batch + 1, 0, 0
        items, total = items + 1, total + n
        out.append(batch)
    return out


def test_exits():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 9, 40]) for _ in range(rng.randrange(1, 30))]
        for i, (begun, items, size) in enumerate(P.exits(sizes, 4, 20)):
            numbers = plain(sizes[i:], 4, 20)
            assert (begun, items, size) == (numbers[-1] + 1, numbers.count(numbers[-1]), sum(s for s, b in zip(sizes[i:], numbers, strict=True) if b == numbers[-1]))


def test_any_skew(spark, monkeypatch):
    rng = random.Random(3)
    groups = {"hot": 3_000, "small": 7, None: 40, "one": 1}
    rows = [(g, i, rng.choice([None, 0, 3, 50, 700]) if g != "one" else 10**6) for g, n in groups.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, i long, size int")
    want = {(g, i): b for g in groups for (_, i, _), b in zip([r for r in rows if r[0] == g], plain([r[2] or 0 for r in rows if r[0] == g], 12, 1_000), strict=True)}
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = P.packed(frame, "g", ["i"], "size", 12, 1_000).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r.g, r.i): r.batch for r in got} == want and len(got) == len(rows)


class Upper:
    def translate(self, texts, style):
        if any("bad" in t for t in texts.values()):
            raise RuntimeError("down")
        return {k: t.upper() for k, t in texts.items()}


def blocks(spark, rows):
    return spark.createDataFrame([(i, h, O.STYLE, t) for i, h, t in rows], "id long, text_hash string, style string, text string")


def test_each_hash_is_sent_once(spark, tmp_path):
    run = O.Run(spark, str(tmp_path / "run"), Upper(), "id")
    run.seed(spark.createDataFrame([("h0", O.STYLE, "zero"), ("h9", O.LEGACY_STYLE, "nine")], "text_hash string, style string, translation string"))
    some = blocks(spark, [(1, "h1", "one"), (2, "h1", "one"), (3, "h0", "nought"), (4, "h9", "neun")])
    assert run.run(some, 0) == {"total": 4, "cached": 2, "translated": 2, "failed": 0, "calls": 1, "batches": 1}
    assert run.run(some, 0) == {"total": 4, "cached": 2, "translated": 2, "failed": 0, "calls": 1, "batches": 1}  # the same version again
    assert run.run(some, 1) == {"total": 4, "cached": 4, "translated": 0, "failed": 0, "calls": 0, "batches": 0}
    assert {(r.text_hash, r.style): r.translation for r in run.cache().collect()} == {("h0", O.STYLE): "zero", ("h1", O.STYLE): "ONE", ("h9", O.LEGACY_STYLE): "nine", ("h9", O.STYLE): "nine"}
    assert run.run(blocks(spark, [(5, "h5", "bad"), (6, "h1", "one")]), 2) == {"total": 2, "cached": 1, "translated": 0, "failed": 1, "calls": 1, "batches": 1}
    failed = spark.read.parquet(f"{run.path}/results/version=2").where("id = 5").first()
    assert failed.translation is None and failed.error == "RuntimeError: down"


def test_a_stream_of_blocks(spark, tmp_path):
    run = O.Run(spark, str(tmp_path / "run"), Upper(), "id")
    run.seed(spark.createDataFrame([], "text_hash string, style string, translation string"))
    source = str(tmp_path / "in")

    def more(rows):
        blocks(spark, rows).coalesce(1).write.mode("append").parquet(source)
        run.follow(spark.readStream.schema("id long, text_hash string, style string, text string").option("maxFilesPerTrigger", 1).parquet(source), str(tmp_path / "state"))

    more([(1, "a", "x"), (2, "b", "y")])
    more([(3, "a", "x"), (4, "c", "z")])
    assert sorted((r.id, r.translation, r.cached) for r in run.results().collect()) == [(1, "X", False), (2, "Y", False), (3, "X", True), (4, "Z", False)]


def test_runs_send_the_first_runs_text_of_a_hash(spark, tmp_path):
    """Texts of one hash that differ: what the even documents' run sends holds for the odd ones too."""
    import duckdb

    from tests.conftest import rows
    from paperlens.plans.catalogue import ORACLE_SQL, QUERIES

    texts = [(2, "beta one two"), (5, "Beta one two"), (7, "Gamma  one"), (11, "gamma one"), (4, "Delta one"), (8, "delta  one"), (1, "DELTA one"), (3, "Epsilon one"), (10, "epsilon one")]
    made = spark.createDataFrame([(i, t, "fr", "web", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(ORACLE_SQL["q_translate_runs"]).df()
    got = QUERIES["q_translate_runs"](spark, str(tmp_path)).toPandas()
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))
