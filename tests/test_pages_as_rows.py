"""Pages that come as one row each: read from files that tasks list, laid out together where that is exact, as one by one elsewhere."""

import io
import random

import pyarrow as pa
import pytest

from paperlens.operators import ingest
from paperlens.operators import layout as L
from paperlens.sources import listing
from paperlens.sources import pdf as P

WORDS = ["a", "word", "(", ")x", ",y", "z ", " q", "", None, "世界", "long\twords here", "[", "end.", "tab\x0b", "\x0bb"]


def made(n, seed=5):
    r = random.Random(seed)
    for _ in range(n):
        kind, page = r.choice(["lines", "columns", "any", "odd"]), []
        for line in range(r.choice([0, 1, 3, 6, 9])):
            at, y = r.choice([0.0, 10.0]), 700.0 - 14 * line + (0.1 * line if kind == "odd" else 0)
            for _ in range(r.choice([1, 2, 5, 12])):
                width = r.choice([0.0, 5.0, 25.0])
                page.append((r.choice(WORDS), at, r.choice([y, y + 1, y + 3]) if kind == "any" else y, -width if kind == "any" and r.random() < 0.1 else width, r.choice([10.0, 10.0, 12.0, 0.0, float("nan")]) if kind == "any" else 10.0))
                at += width + r.choice([0.0, 1.0, 2.0, 5.0, 80.0] if kind != "columns" else [2.0, 3.0, 300.0])
        if kind == "any":
            r.shuffle(page)
        yield page


def test_same_text_as_from_rows_of_items(spark):
    pages = list(made(400))
    rows = [(n, i, *item) for n, page in enumerate(pages) for i, item in enumerate(page)] + [(n, None, *[None] * 5) for n, page in enumerate(pages) if not page]
    items = spark.createDataFrame(rows, "page int, idx int, text string, x double, y double, width double, height double")
    items = items.withColumn("height", L.finite(items.height))
    want = {r.page: r.text for r in L.page_texts(items, ["page"]).collect()}
    lists = [pa.array([[item[k] for item in page] for page in pages], pa.list_(pa.float64() if k else pa.string())) for k in range(5)]
    got = dict(enumerate(L.texts(*lists).to_pylist()))
    assert L.texts(*(c.slice(7, 50) for c in lists)).to_pylist() == [got[n] for n in range(7, 57)]
    assert got == want and sum("\n" in t for t in got.values()) > 200 and sum(" " in t for t in got.values()) > 200


def test_written_pages_are_not_walked_one_by_one(monkeypatch):
    pdf = P.Pdf(io.BytesIO(P.written([[f"line {i} of (page) , one", "", "two  gaps"] for i in range(3)])))
    pages = [P._together(pdf, i) for i in range(3)]
    monkeypatch.setattr(L, "_reading", None)
    lists = [pa.array([list(p[k]) for p in pages], pa.list_(pa.float64() if k else pa.string())) for k in range(5)]
    assert L.texts(*lists).to_pylist() == [f"line {i} of (page), one\ntwo gaps" for i in range(3)]


def test_lines_of_a_written_page_are_one_operator():
    lines = [" indented  twice ", *(f"line {i} of 40" for i in range(39)), "", " "]
    pdf = P.Pdf(io.BytesIO(P.written([lines])))
    assert [op for op, _ in P.operations(pdf.content(pdf.page(0)))] == [b"BT", b"Tf", b"Tm TJ Tm TJ", b"ET"]
    want = [(word, P.LEFT + P.PITCH * at, P.TOP - P.LEADING * n, P.PITCH * len(word)) for n, line in enumerate(lines) for at, word in ((m.start(), m[0]) for m in P.re.finditer("[^ ]+", line))]
    assert [(text, t[4], t[5], width) for text, t, width, _ in P.items(pdf, pdf.page(0))] == want


def test_files_in_sub_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver asks the store for nothing; files of sub-folders come with the others, large ones in shares, damaged ones as rows."""
    lines = [[f"page {i} line {j} 世界 end" for j in range(3)] for i in range(50)]
    P.write(spark.createDataFrame([("big", lines), *((f"n{i}", [[f"file {i}"], []]) for i in range(20))], "name string, pages array<array<string>>"), str(tmp_path / "f"), folders=8)
    (tmp_path / "f" / "broken.PDF").write_bytes(b"%PDF- nothing")
    (tmp_path / "f" / "other.txt").write_bytes(b"x")
    assert 4 < len([p for p in (tmp_path / "f").iterdir() if p.is_dir()]) <= 8
    monkeypatch.setattr(listing, "place", None)
    monkeypatch.setattr(P, "place", None)
    got = {(r.file.split("/")[-1], r.page_number): (r.text, r.error is None) for r in ingest.file_texts(spark, str(tmp_path / "f"), split_bytes=1_000).collect()}
    want = {("big.pdf", i + 1): ("\n".join(page), True) for i, page in enumerate(lines)} | {("broken.PDF", 0): (None, False)}
    want |= {(f"n{i}.pdf", k): (f"file {i}" if k == 1 else "", True) for i in range(20) for k in (1, 2)}
    assert got == want
    assert {(r.file.split("/")[-1], r.page_number) for r in P.read(spark, str(tmp_path / "f"), split_bytes=1_000, contents=False).collect()} == want.keys()
    assert sum(map(len, (r.str for r in P.pages(spark, str(tmp_path / "f")).collect()))) == 50 * 18 + 40
    assert listing.listed(spark, str(tmp_path / "nowhere")).count() == 0


CONTENTS = [
    b"BT /F 10 Tf " + b" ".join(b"1 0 0 1 %d 700 Tm <%s> Tj" % (50 * i, w) for i, w in enumerate([b"4142", b"", b"41", b"4", b"20 ", b"424241"])) + b" ET",
    b"q 2 0 0 2 10 20 cm 3 Ts BT /F 10 Tf 1 Tc " + b"\n".join(b"1 0 .5 1 %d 7.5 Tm <4142> Tj" % i for i in range(6)) + b" (x) Tj ET Q BT /F 8 Tf " + b" ".join(b"1 0 0 -1 5 6 Tm <4142> Tj" for _ in range(5)) + b" T* (y) Tj ET",
]

LINES = [
    b"BT /F 10 Tf " + b"\n".join(b"1 0 0 1 50 %d Tm [<4142> -500 <41> 350.5 <> -101 <4142>]TJ" % (700 - 14 * i) for i in range(5)) + b" (x) Tj ET",
    b"q 2 0 0 2 10 20 cm 3 Ts BT /F 10 Tf 1 Tc " + b" ".join(b"1 .5 0 1 %d 7 Tm [ <4142> -500 <4142> ] TJ" % i for i in range(4)) + b" T* (y) Tj ET Q",
    b"BT /F 10 Tf 1 0 0 1 5 6 Tm [<4142> -500 <4142> 100 <4142>] TJ 1 0 0 1 5 6 Tm [<4142>] TJ [<4142> -500 <4142>] TJ (z) Tj ET",
]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("content", CONTENTS + LINES)
def test_runs_of_words_are_what_single_ones_are(content, wide, monkeypatch):
    class One(P.Pdf):
        def __init__(self):
            self.fonts = {}

        def content(self, page):
            return content

        def resolve(self, x):
            return x

    cmap = P.Stream({}, b"2 beginbfchar <4142> <0058><2020> <2603>\n<0041> <0031> endbfchar 1 beginbfchar <4241> <00660069> endbfchar")
    page = {"Resources": {"Font": {"F": {"Subtype": "Type0", "ToUnicode": cmap, "DescendantFonts": [{"DW": 500}]} if wide else {}}}}
    got = list(P.items(One(), page))
    assert [op for op, _ in P.operations(content) if op[:4] == b"Tm T"] or content == LINES[2]
    for pattern in ("_RUN", "_ROWS"):
        monkeypatch.setattr(P, pattern, P.re.compile(b"(?!)"))
    assert list(P.items(One(), page)) == got and got


def test_pairs_of_a_font_read_at_once():
    pairs = b"3 beginbfchar <0001> <0041>\n<0002><0042> <0003>\t<2603> endbfchar "
    assert P._unicode(pairs) == {1: "A", 2: "B", 3: "☃"}
    assert P._unicode(pairs + b"1 beginbfchar <0004> <D83DDE42> endbfchar 1 beginbfrange <05> <06> <0061> endbfrange") == {1: "A", 2: "B", 3: "☃", 4: "🙂", 5: "a", 6: "b"}
    assert P._unicode(b"1 beginbfchar <41> <0391> endbfchar " + pairs) == {0x41: "Α", 1: "A", 2: "B", 3: "☃"}
    assert P._unicode(b"1 beginbfchar <0001> <D83D> endbfchar") == {1: "\ufffd"}
