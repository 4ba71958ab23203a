from pyspark.sql import functions as F

from paperlens.llm import license_scan as S
from paperlens.llm import quality_rules as Q
from paperlens.llm.license_templates import TEMPLATES
from paperlens.llm.queries import ORACLE_SQL, QUERIES


def test_rules_same_as_sql(same_rows):
    same_rows(QUERIES["op8_quality_rules"], ORACLE_SQL["op8_quality_rules"])


def test_ablations_same_as_sql(same_rows):
    same_rows(QUERIES["quality_ablations"], ORACLE_SQL["quality_ablations"])


def test_licences_same_as_sql(same_rows):
    same_rows(QUERIES["op9_license_scan"], ORACLE_SQL["op9_license_scan"])


def brute(text):
    import re

    words = re.findall(r"[^ \t\n\r\x0b\x0c]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    texts = [None, "", "a", "a b c d e f g h " * 3, "x " * 40, "one\ntwo\none\n \n \n", "é世😀 #*$%&|<>!!", " ".join(map(str, range(60))) + " " + " ".join(map(str, range(30, 45))), "\x0b\x0c\t \r", "w\xa0w " * 30]
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "a b", 1), (0, None, 1)], "doc_id long, text string, n_words int")
    got = Q.judged(frame).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = brute("a b" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_ablations(spark):
    texts = ["word " * 5, "many different words " + " ".join(f"w{i}" for i in range(40)), "A # B # C # D # " * 2 + " ".join(f"w{i}" for i in range(12)), "UP " + " ".join(f"ABC{chr(65 + i % 26)}{i}" for i in range(30))]
    found = Q.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    failures = [r.failures for r in found.collect()]
    for policy in Q.POLICIES:
        mask = Q.mask(policy)
        for r in Q.ablations(found, policy).collect():
            bit = 1 << list(Q.RULES).index(r.rule)
            assert r.fail == sum(bool(f & bit) for f in failures)
            assert r.fail_alone == sum(f & mask == bit for f in failures)
            assert r.kept_without == sum(f & mask & ~bit == 0 for f in failures)
        assert found.where(Q.passes(policy)).count() == sum(f & mask == 0 for f in failures)


def test_licences(spark):
    mit = TEMPLATES["MIT"]
    rows = [(1, f"Intro line\n\n{mit}\n\nmore text"), (2, mit.replace("Software", "Program")), (3, "nothing here\nReleased under the MIT License.\n"), (4, None), (5, ""), (6, "released"), (None, "Licensed under CC BY-NC 4.0."), (3, "nothing here\nReleased under the MIT License.\n")]
    got = sorted((r.doc_id or -1, r.licenses) for r in S.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, licenses int")).collect())
    assert got[0] == (-1, "CC-BY-NC-4.0-notice") and got[1] == (1, "MIT")
    assert got[3:5] == [(3, "MIT-notice")] * 2 and [x[1] for x in got[5:]] == [None, None, None]
    assert S.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dice_against_brute_force(spark):
    import random

    random.seed(7)
    mit = TEMPLATES["Apache-2.0-header"].split()
    texts = []
    for i in range(30):
        w = list(mit)
        for _ in range(i):
            w[random.randrange(len(w))] = f"z{random.random()}"
        texts.append(" ".join(w))
    grams = S.template_bigrams()["Apache-2.0-header"]
    got = {r.doc_id: r.best_dice for r in S.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        own = set(S.template_bigrams({"x": t})["x"])
        dice = 2 * len(own & set(grams)) / (len(own) + len(grams))
        assert got[i] == (round(dice, 6) if dice >= 0.8 else 0.0)


def best_span(text, name):
    """Best Dice of any run of words against a template, by trying all of them."""
    import re

    words = [w for w in re.split(S.BREAKS, text.lower()) if w]
    grams, own, best = [f"{a} {b}" for a, b in zip(words, words[1:])], set(S.template_bigrams()[name]), 0.0
    for a in range(len(grams)):
        seen = set()
        for g in grams[a:]:
            seen.add(g)
            best = max(best, 2 * len(seen & own) / (len(seen) + len(own)))
    return round(best, 6) if best >= 0.8 else 0.0


def test_licences_of_several_paragraphs_and_notices_within_lines(spark, tmp_path):
    import re

    around = " ".join(f"other{i}" for i in range(200))
    texts = {}
    for name in ("MIT", "BSD-2-Clause", "Apache-2.0-header", "GPL-3.0-header"):
        paragraphs = re.sub(r"(?<=[.:;]) +(?=[A-Z0-9])", "\n\n", TEMPLATES[name].replace("\n", " "))
        assert paragraphs.count("\n\n") > 1
        texts[name] = f"{around}\n\n{paragraphs}\n\n{around}"
    rows = [(i, t) for i, t in enumerate(texts.values())]
    notice = TEMPLATES["MIT-notice"]
    rows += [(10, f"{around} Copyright 2020 Jane Doe. {notice} {around}"), (11, f"{around} {notice} {around} {notice} {notice} {around}"), (12, f"{around}\nReleased under\nthe MIT\nLicense.\n{around}"), (13, around)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op9_license_scan"](spark, str(tmp_path)).collect()}
    for i, (name, text) in enumerate(texts.items()):
        assert name in got[i].licenses.split(",") and got[i].best_dice >= best_span(text, name) >= 0.99, got[i]
    assert [(got[i].licenses, got[i].n_matches, got[i].best_dice) for i in (10, 11, 12, 13)] == [("MIT-notice", 1, 1.0), ("MIT-notice", 3, 1.0), ("MIT-notice", 1, 1.0), (None, 0, 0.0)]


def test_spans_against_brute_force(spark):
    import random

    random.seed(3)
    name, texts = "BSD-3-Clause-notice", []
    words = TEMPLATES[name].split()
    for i in range(60):
        w = list(words)
        for _ in range(i // 6):
            k = random.randrange(len(w))
            w[k : k + random.randint(0, 1)] = random.choice([[f"z{random.random()}"], w[:2], [w[k]], [w[k], "x"]])
        texts.append(" ".join([*random.choices(["a", "that", "can", "be", "z"], k=20), *w, *random.choices(words, k=20)]))
    got = {r.id: r.best for r in S.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {name: TEMPLATES[name]}).collect()}
    assert {i: round(b, 6) for i, b in got.items()} == {i: best_span(t, name) for i, t in enumerate(texts) if best_span(t, name)} and 0 < len(got) < 60


def test_ledger_runs_without_python(spark):
    frame = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    for out in (Q.judged(frame), S.scan(frame)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
