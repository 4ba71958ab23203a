import hashlib
import random
import re

from paperlens.llm import decontamination as D
from paperlens.llm.queries import ORACLE_SQL, QUERIES


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            own = words(t)
            n = min(10, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out.append((i if i is not None else -1, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_same_as_brute_force(spark):
    random.seed(5)
    vocabulary = ["alpha", "Beta", "gamma3", "été", "世界", "x"]
    text = lambda n: " ".join(random.choice(vocabulary) + random.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(i, text(random.choice([3, 5, 9, 10, 11, 14, 30]))) for i in range(25)] + [(25, None), (26, ""), (27, "..."), (3, None), (10, text(12)), (10, text(12))]
    own = [t for _, t in items if t]
    docs = [(i, f"{text(random.randint(0, 60))} {random.choice(own).upper()}" if random.random() < 0.5 else text(40)) for i in range(40)]
    docs += [(100, None), (101, ""), (7, docs[3][1]), (7, docs[3][1]), (None, docs[4][1])]
    got = D.contamination(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_hit int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(docs, items)


def test_same_as_sql(same_rows):
    same_rows(QUERIES["op4_decontamination"], ORACLE_SQL["op4_decontamination"])


def test_joins_without_broadcast(spark, monkeypatch):
    import paperlens.llm.common as common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "clean " * 30)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.contaminated) for r in D.contamination(docs, bench).collect()} == {1: (12, True), 2: (0, False)}
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == [2]


def test_words_do_not_meet_the_fingerprints(spark, monkeypatch):
    """Beyond the broadcast bound the join on fingerprints has narrow rows: no array of words beside a k-gram."""
    import paperlens.llm.common as common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "clean " * 30), (1, f"before {item} after")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    out = D.window_hits(D._keyed(docs, "doc_id", "text"), D._items(bench, "item_id", "text"))
    assert sorted((r.id, r["first"]) for r in out.collect()) == [(1, 1), (1, 2), (1, 3)]
    stack, seen = [out._jdf.queryExecution().optimizedPlan()], 0
    while stack:
        node = stack.pop()
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
        if node.nodeName() == "Join" and "LeftSemi" in node.toString().split("\n")[0]:
            assert "words" not in node.output().toString()
            seen += 1
    assert seen


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [(r.n_hit, r.contaminated) for r in D.contamination(docs, bench.limit(0)).collect()] == [(0, False)]
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == 1


def test_runs_without_python(spark):
    docs, bench = spark.createDataFrame([(1, "a b c " * 9)], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, "b c a " * 5)], "item_id long, text string")
    for out in (D.contamination(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")), D.window_hits(D._keyed(docs, "doc_id", "text"), D._items(bench, "item_id", "text"))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
