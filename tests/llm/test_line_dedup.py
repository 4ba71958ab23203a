import random

from pyspark.sql import functions as F

from paperlens.llm import line_dedup as L


def brute(docs, least):
    """Deleted line numbers of (id, text) documents with distinct ids: every later copy of a run of at least `least` words."""
    seqs, order = {}, sorted(docs)
    for i, text in order:
        seqs[i] = [(n, line.strip(" \t\n\r\x0b\x0c")) for n, line in enumerate((text or "").split("\n")) if line.strip(" \t\n\r\x0b\x0c")]
    first, gone = {}, {i: set() for i, _ in order}
    for i, _ in order:
        for s in range(len(seqs[i])):
            for e in range(s + 1, len(seqs[i]) + 1):
                run = tuple(line for _, line in seqs[i][s:e])
                if sum(len(x.split()) for x in run) >= least and first.setdefault(run, (i, s)) != (i, s):
                    gone[i] |= {n for n, _ in seqs[i][s:e]}
    return gone


def test_same_as_brute_force(spark):
    random.seed(4)
    lines = [" ".join(f"w{random.randrange(30)}" for _ in range(random.choice([1, 2, 3, 5, 12]))) for _ in range(25)] + ["", "  "]
    docs = [(i, "\n".join(random.choice(lines) if random.random() < 0.7 else f"own {i} {j} {random.random()}" for j in range(random.randint(1, 12)))) for i in range(60)]
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "\n".join(["same line here"] * 9)), (103, ""), (104, None)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, line int")
    for least in (4, 10):
        gone = brute(docs, least)
        assert any(gone.values())
        got = {r.doc_id: r for r in L.without_repeats(frame, least).collect()}
        for i, text in docs:
            rest = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[i])
            assert got[i]["lines deleted"] == len(gone[i]), i
            assert got[i].text == (rest if rest is None or not gone[i] or rest.strip() else ""), i


def test_repeated_rows_share_a_result(spark):
    text = "a line of more than ten words that stands in both of them here"
    frame = spark.createDataFrame([(5, text), (5, text), (6, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text) for r in L.without_repeats(frame).collect())
    assert got == [(-1, text), (5, ""), (5, ""), (6, "")]


def test_doubling_names_runs(spark):
    frame = spark.createDataFrame([(1, "a\nb\nc\nd\nx"), (2, "y\na\nb\nc\nd")], "doc_id long, text string")
    got = {(r.id, r.s): r.names for r in L.doubled(frame, 4).collect()}
    assert got[(1, 0)] == got[(2, 1)] and len(got[(1, 0)]) == 3 and all(n is not None for n in got[(1, 0)])
    assert got[(1, 2)][1] == got[(2, 3)][1] and got[(1, 2)][2] is None


def test_empty_table(spark):
    assert L.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert L.without_repeats(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))).count() == 3
