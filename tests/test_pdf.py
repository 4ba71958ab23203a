"""The PDF source on files of its own and on others made by hand: compressed objects, predictors, kerning, damage."""

import io
import zlib

import pytest

from paperlens.operators import ingest
from paperlens.sources import pdf as P


def texts(data):
    return [(r[1], r[3], r[7]) for r in P.rows_of("f", io.BytesIO(data))]


def by_hand(content, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 32 /Widths [250 250] >>", compressed=False):
    """One page; with compressed, its objects in a stream of objects and a cross-reference stream with a predictor."""
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] /Resources << /Font << /F 4 0 R >> >> >>", 4: font}
    out, places = bytearray(b"%PDF-1.5\n"), {}

    def add(n, body):
        places[n] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (n, body))

    def stream(about, data):
        return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (about, len(data), data)

    add(5, stream(b"", content))
    if not compressed:
        for n, body in bodies.items():
            add(n, body)
        start = len(out)
        out.extend(b"xref\n0 6\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % places[n] for n in range(1, 6)) + b"trailer\n<< /Size 6 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % start)
        return bytes(out)
    heads, at = [], 0
    for n, body in bodies.items():
        heads.append(f"{n} {at}")
        at += len(body) + 1
    head = " ".join(heads).encode() + b" "
    add(6, stream(b"/Type /ObjStm /N 4 /First %d /Filter /FlateDecode" % len(head), zlib.compress(head + b" ".join(bodies.values()))))
    rows = [bytes([2]) + (6).to_bytes(3, "big") + bytes([i]) for i in range(4)] + [bytes([1]) + places[n].to_bytes(3, "big") + b"\0" for n in (5, 6)]
    coded, above = b"", bytes(5)
    for row in rows:  # the predictor named up
        coded += b"\2" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True))
        above = row
    start = len(out)
    add(7, stream(b"/Type /XRef /Size 8 /W [1 3 1] /Index [1 6] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >>", zlib.compress(coded)))
    return bytes(out) + b"startxref\n%d\n%%%%EOF" % start


CONTENT = b"q 2 0 0 2 10 20 cm BT /F 10 Tf 12 TL 1 0 0 1 5 100 Tm (He\\154lo) Tj T* [(wor) -20 (ld) -300 (far)] TJ (a\\(b\\)c) ' ET Q BT /F 8 Tf 3 4 Td <414243> Tj ET"


@pytest.mark.parametrize("compressed", [False, True])
def test_operators_and_places(compressed):
    rows = list(P.rows_of("f", io.BytesIO(by_hand(CONTENT, compressed=compressed))))
    assert [(r[3], r[4][4:], r[6]) for r in rows] == [("Hello", [20, 220], 20), ("world", [20, 196], 20), ("far", [pytest.approx(20 + 2 * (25 + 0.2 + 3)), 196], 20), ("a(b)c", [20, 172], 20), ("ABC", [3, 4], 8)]
    assert rows[0][5] == 50 and rows[0][7] is None


def test_damage_becomes_rows():
    good = by_hand(CONTENT)
    assert texts(good.replace(b"startxref", b"startxyyy")) == texts(good)  # objects are searched for
    assert texts(good.replace(b"0000000009", b"0000000011")) == texts(good)
    assert [(p, s, e is None) for p, s, e in texts(b"no file")] == [(0, None, False)] == [(p, s, e is None) for p, s, e in texts(b"")]
    assert texts(good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")) == [(0, None, "ValueError: the file is encrypted")]
    two = P.written([["one"], ["two"]])
    first = two.index(b"stream", two.index(b"/FlateDecode"))
    assert [(p, s) for p, s, e in texts(two[: first + 10] + b"\xff" + two[first + 11 :])] == [(1, None), (2, "two")]


def test_fonts():
    cmap = b"1 beginbfrange <41> <43> <0391> endbfrange 1 beginbfchar <44> <D83DDE42> endbfchar"
    data = by_hand(b"BT /F 10 Tf (ABCD) Tj ET")
    data = data.replace(b"/FirstChar 32 /Widths [250 250]", b"/ToUnicode 8 0 R").replace(b"%PDF-1.5\n", b"%PDF-1.5\n8 0 obj\n<< /Length " + str(len(cmap)).encode() + b" >>\nstream\n" + cmap + b"\nendstream\nendobj\n")
    assert texts(data) == [(1, "ΑΒΓ🙂", None)]


def test_shares_of_pages(spark, tmp_path):
    lines = [[f"page {i} line {j} 世界 end" for j in range(3)] for i in range(50)]
    rows = [("big", lines), ("small", [["(one) word"], [], ["last , page"]]), ("none", [[]])]
    P.write(spark.createDataFrame(rows, "name string, pages array<array<string>>"), str(tmp_path / "f"))
    (tmp_path / "f" / "broken.pdf").write_bytes(b"%PDF- nothing")
    (tmp_path / "f" / "other.txt").write_bytes(b"x")
    items = P.read(spark, str(tmp_path / "f"), split_bytes=1_000)
    assert len(P.PdfReader({"path": str(tmp_path / "f"), "split_bytes": "1000"}).partitions()) > 10
    got = {(r.file, r.page_number): (r.text, r.error is None) for r in ingest.page_texts(items).collect()}
    want = {("big.pdf", i + 1): ("\n".join(page), True) for i, page in enumerate(lines)}
    want |= {("small.pdf", 1): ("(one) word", True), ("small.pdf", 2): ("", True), ("small.pdf", 3): ("last, page", True), ("none.pdf", 1): ("", True), ("broken.pdf", 0): (None, False)}
    assert got == want
    assert P.read(spark, str(tmp_path / "nowhere")).count() == 0


def test_stream_reads_each_file_once(spark, tmp_path):
    def add(name, text):
        P.write(spark.createDataFrame([(name, [[text]])], "name string, pages array<array<string>>"), str(tmp_path / "in"))

    def run():
        P.arriving(spark, str(tmp_path / "in"), 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    add("a", "first")
    run()
    add("b", "second")
    (tmp_path / "in" / "c.pdf").write_bytes(b"junk")
    run()
    run()
    assert sorted((r.file.rsplit("/", 1)[-1], r.str or r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a.pdf", "first"), ("b.pdf", "second"), ("c.pdf", "ValueError: no catalogue of pages")]


def test_pages_without_their_contents(spark, tmp_path, monkeypatch):
    """Pages are counted without a look at their text, by file, damaged ones as before."""
    import io

    from paperlens.sources import pdf

    texts = [("a", [["one"], ["two words"], []]), ("b", [["x y"]])]
    pdf.write(spark.createDataFrame(texts, "name string, pages array<array<string>>"), str(tmp_path))
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    got = {(r.file, r.page_number, r.idx, r.error is None) for r in pdf.read(spark, str(tmp_path), contents=False).collect()}
    assert got == {("a.pdf", 1, None, True), ("a.pdf", 2, None, True), ("a.pdf", 3, None, True), ("b.pdf", 1, None, True), ("bad.pdf", 0, None, False)}
    monkeypatch.setattr(pdf, "items", lambda *_: 1 / 0)
    assert [r[1] for r in pdf.rows_of("a", io.BytesIO((tmp_path / "a.pdf").read_bytes()), contents=False)] == [1, 2, 3]
