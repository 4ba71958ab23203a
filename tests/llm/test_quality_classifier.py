import zlib

import numpy as np
import pytest

from paperlens.llm import quality_classifier as Q

DATA = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = Q.quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id", how="left")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert all(h == held(i) for i, h in zip(got.doc_id, got.held_out))
    assert (got.predicted == (got.score >= 0.3)).all()
    test = got[got.held_out & got.quality.notna()]
    assert test[test.quality == 1].predicted.mean() == 1
    assert ((test.score >= 0.5) == test.quality).mean() > 0.9


def test_labels_of_held_out_rows_are_never_used(spark):
    docs = spark.createDataFrame([(i, f"text number {i} !!" if i % 2 else f"plain words {i}") for i in range(200)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(200)]
    flipped = [(i, 1 - y if held(i) else y) for i, y in labels]
    a, b = (Q.train(docs, spark.createDataFrame(x, "doc_id long, quality int").where(~Q.held_out())) for x in (labels, flipped))
    assert (a == b).all() and a.any()


def test_bound_on_the_sample(spark):
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    few = Q.train(docs, labels, limit=10)
    assert 0 < np.count_nonzero(few) <= 10 * 8 + 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (None, "a b", 9), (2, "", 9), (2, "x " * 50_000, 9)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.quality(docs, none).collect()] == [0.5] * 4
    assert Q.quality(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = Q.accepted(docs.withColumn("predicted", Q.F.lit("own")).withColumn("held_out", Q.F.lit(7)), labels, threshold=0).collect()
    assert len(got) == 4 and all((r.score, r.predicted, r.held_out) == (9, "own", 7) for r in got)


def test_same_as_naive_ftrl(spark):
    """The update rule coordinate by coordinate, in plain Python, over the same rows in the same order."""
    import math

    docs = [(i, f"{'bad!!' if i % 3 == 0 else 'good words'} number {i % 7} of them") for i in range(60)]
    labels = [(i, int(i % 3 != 0)) for i in range(60)]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    place = {r.doc_id: (r.at, r.shard) for r in frame.select("doc_id", Q.F.xxhash64("doc_id").alias("at")).withColumn("shard", Q.F.pmod("at", Q.F.lit(Q.SHARDS))).collect()}
    total, count = np.zeros(Q.SLOTS + 1), 0
    for shard in range(Q.SHARDS):
        own = sorted((at, i) for i, (at, s) in place.items() if s == shard)
        z, n = {}, {}

        def weight(k):
            if abs(z.get(k, 0.0)) <= Q.L1:
                return 0.0
            return -(z[k] - math.copysign(Q.L1, z[k])) / ((Q.BETA + math.sqrt(n[k])) / Q.ALPHA + Q.L2)

        for _ in range(Q.PASSES):
            for _, i in own:
                slots, values = Q.features(docs[i][1])
                x = {int(k): float(v) for k, v in zip(slots, values)} | {Q.SLOTS: 1.0}
                w = {k: weight(k) for k in x}
                p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
                for k, v in x.items():
                    g = (p - labels[i][1]) * v
                    sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / Q.ALPHA
                    z[k] = z.get(k, 0.0) + g - sigma * w[k]
                    n[k] = n.get(k, 0.0) + g * g
        for k in z:
            total[k] += weight(k) * len(own)
        count += len(own)
    assert Q.train(frame, marks) == pytest.approx(total / count, abs=1e-4)


def test_long_runs_of_signs_differ():
    assert set(Q.features("!" * 40)[0]) != set(Q.features("!" * 41)[0])


def test_sparse_dot_product():
    slots, values = Q.features("One two two. One!!")
    assert len(set(slots)) == len(slots) and values @ values == pytest.approx(1, abs=1e-5)
    assert len(Q.features("")[0]) == len(Q.features(None)[0]) == 0
