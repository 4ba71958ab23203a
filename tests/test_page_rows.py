"""Pages as one row each: the same texts as the steps one by one, one exchange, and files whose objects are read once."""

import io
import random

from pyspark.sql import functions as F

from paperlens.operators import ingest
from paperlens.operators import layout as L
from paperlens.sources import pdf as P

SCHEMA = "page long, idx int, text string, x double, y double, width double, height double"
WORDS = ["a", "word", "(", ")x", ",y", "z ", " q", "", None, "世界", "long\twords here", "[", "end."]


def pages(n, seed=3):
    r = random.Random(seed)
    for page in range(n):
        wide = page % 3 == 0  # two columns
        for i in range(r.choice([1, 2, 4, 7, 30])):
            x = r.choice([0.0, 20.0, 40.0, 300.0, 330.0]) if wide else r.uniform(0, 200)
            yield page, i, r.choice(WORDS), x, float(r.choice([10, 11, 12, 14, 20, 21.5, 40])), r.choice([0.0, 10.0, 25.0]), r.choice([0.0, 1.0, 8.0])


def test_same_as_the_steps_one_by_one(spark):
    items = spark.createDataFrame(list(pages(150)), SCHEMA)
    got = {r.page: r.text for r in L.page_texts(items, ["page"]).collect()}
    texts = L.joined_line(L.clustered(items, ["page"]), ["page", "line", "line_y"]).withColumnRenamed("line_y", "y")
    lines = L.ordered_lines(L.columns_of(texts.withColumn("order", F.col("line")), ["page"]), ["page"])
    want = {}
    for r in sorted(lines.collect(), key=lambda r: (r.page, r.place)):
        want.setdefault(r.page, []).append(r.text)
    assert got == {page: "\n".join(some) for page, some in want.items()} and len(got) == 150
    assert max(map(len, want.values())) > 4


def test_one_exchange(spark):
    items = spark.createDataFrame(list(pages(5)), SCHEMA)
    assert L.page_texts(items, ["page"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_pages_without_items_and_with_errors(spark):
    rows = [("f", 1, None, None, None, None, None, None), ("f", 2, None, None, None, None, None, "bad"), ("f", 3, 0, "x", [1.0, 0.0, 0.0, 1.0, 5.0, 5.0], 5.0, 10.0, None)]
    got = {r.page_number: (r.text, r.error) for r in ingest.page_texts(spark.createDataFrame(rows, P.SCHEMA)).collect()}
    assert got == {1: ("", None), 2: (None, "bad"), 3: ("x", None)}


def test_objects_of_a_file_are_read_once(monkeypatch):
    data, read, fonts = P.written([[f"page {i}", "some words"] for i in range(120)]), [], []
    inner, made = P.Pdf._object_at, P.Font.__init__
    monkeypatch.setattr(P.Pdf, "_object_at", lambda self, at, number=None: (read.append(number), inner(self, at, number))[1])
    monkeypatch.setattr(P.Font, "__init__", lambda self, pdf, about: (fonts.append(1), made(self, pdf, about))[1])
    rows = list(P.rows_of("f", io.BytesIO(data)))
    assert [r[3] for r in rows][-4:] == ["page", "119", "some", "words"] and len(rows) == 480
    assert len(read) < 4 * 120 and len(fonts) == 1
    assert [r[:4] for share in range(7) for r in P.rows_of("f", io.BytesIO(data), share, 7)] == [r[:4] for r in rows]


def test_operations_are_what_values_are():
    content = b"%c 1 Tf\n/F 10 Tf % 3\n1 0 0 1 5 6. Tm <41 4> Tj -.5 +7 Td (a(b)\\)) Tj [(x)-3 <42>] TJ 12(y)' true null << /A [1 2] >> sh 1 0 0 1 5 6 Tm <4142>Tj 1 0 0 1 5 6 Tm <4142> Tj\n1-2 x { 3 } 4 0 R 9 8 7 6 5 4 3 Tm ET 5"
    want, args = [], []
    for value, _ in P.values(content):
        if isinstance(value, P.Operator):
            want.append((bytes(value), args))
            args = []
        else:
            args.append(value)
    got = []
    for op, args in P.operations(content):
        if op == b"Tm Tj":
            got += [(b"Tm", [*map(float, args[0].split()), float(args[1]), float(args[2])]), (b"Tj", [bytes.fromhex(args[3][1:-1].decode())])]
        else:
            got.append((op, args))
    assert got == want and len(got) > 12


def test_codes_in_the_range_of_surrogates():
    """Codes that look like half of a pair are looked up one by one, unknown ones have no text."""

    class One:
        def resolve(self, x):
            return x

    cmap = P.Stream({}, b"2 beginbfchar <D83D> <0041> <DE42> <0042> endbfchar 1 beginbfchar <0001> <0043> endbfchar")
    font = P.Font(One(), {"Subtype": "Type0", "ToUnicode": cmap, "DescendantFonts": [{"DW": 500}]})
    assert [font.read(bytes.fromhex(c)) for c in ("D83DDE42", "D83D0001", "00010002", "0001FF")] == [("AB", 1000, 2, 0), ("AC", 1000, 2, 0), ("C", 1000, 2, 0), ("C", 500, 1, 0)]
