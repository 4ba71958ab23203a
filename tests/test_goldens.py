"""Literal cases of the text, grammar, layout and passage operators."""

from pyspark.sql import functions as F

from paperlens.functions import metadata as M
from paperlens.functions import quality as Q
from paperlens.functions import text as T
from paperlens.operators import grammar as G
from paperlens.operators import layout as L
from paperlens.operators import passages as P
from paperlens.operators import relational as R
from paperlens.operators import translation as O


def one(spark, value, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(value(F.col("t")).alias("v")).first().v


def test_heading_types(spark):
    kind = lambda text, part: one(spark, lambda t: G.classify_heading(t, F.lit(part)), text)
    assert kind("Part I Writing", "unknown") == "writing"
    assert kind("Part II Listening Comprehension", "unknown") == "listening"
    assert [kind(f"Section {x}", "reading") for x in "ABC"] == ["reading_bank", "reading_matching", "reading_careful"]
    assert kind("Part III Reading", "unknown") == "unknown"


def test_type_from_number(spark):
    got = [r.v for r in spark.createDataFrame([(n,) for n in (1, 25, 26, 35, 36, 45, 46, 55, 56)], "n int").select(G.type_from_number(F.col("n")).alias("v")).collect()]
    assert got == ["listening"] * 2 + ["reading_bank"] * 2 + ["reading_matching"] * 2 + ["reading_careful"] * 2 + ["unknown"]


def test_fragments(spark):
    for text in ("with", "1", "", "(30 minutes) (30 minutes) with", "2021 年 12 月大学英语六级真题 第 1 页 共 11 页"):
        assert one(spark, lambda t: G.is_fragment(G.normalize_line(t)), text)
    assert not one(spark, lambda t: G.is_fragment(G.normalize_line(t), in_word_bank=True), "with")


def test_word_bank_and_options(spark):
    assert [tuple(x) for x in one(spark, lambda t: G.word_bank(G.normalize_line(t)), "A) affect B) beyond 0) trait")] == [("A", "affect"), ("B", "beyond"), ("O", "trait")]
    got = one(spark, lambda t: G.options(G.normalize_line(t)), "A) Santa Claus. B) A polar bear. C) Cocoa seeds. D) A glass bottle.")
    assert [tuple(x) for x in got] == [("A", "Santa Claus."), ("B", "A polar bear."), ("C", "Cocoa seeds."), ("D", "A glass bottle.")]


def test_line_rewrites(spark):
    assert one(spark, G.normalize_line, "Part 1 “Writing”") == 'Part I "Writing"'
    assert one(spark, G.normalize_line, "fo llowing f our 12 . A)x") == "following four 12. A) x"


def test_extracted_text(spark):
    assert one(spark, T.normalize_extracted, "three or f our questions") == "three or four questions"
    assert one(spark, T.normalize_extracted, "fo llowing passage") == "following passage"
    assert one(spark, T.normalize_extracted, "Part 1V Translation") == "Part IV Translation"
    assert one(spark, T.normalize_extracted, "一 二 ， 三") == "一二，三"


def test_sentences(spark):
    assert one(spark, T.sentences_en, "One. Two? Three!") == ["One.", "Two?", "Three!"]
    assert one(spark, T.sentences_zh, "一。二？三！四；") == ["一。", "二？", "三！", "四；"]
    assert one(spark, T.sentences_en, "") == []
    assert one(spark, T.sentences_en, "...") == ["..."]


def test_paragraph_packing(spark):
    text = " ".join(["word " * 30 + "end."] * 9)
    packs = one(spark, T.paragraphs, text)
    assert [p.count("end.") for p in packs] == [3, 3, 3] or [p.count("end.") for p in packs] == [4, 4, 1]
    assert " ".join(packs).split() == text.split()


def test_passages(spark):
    frame = spark.createDataFrame([("block-1", "First sentence. Second sentence.", "第一句。第二句。"), ("block-2", "One para.\n\nTwo para.", "一段。\n\n二段。")], "b string, en string, zh string")
    got = [r.v for r in frame.select(P.paragraph_structure(F.col("b"), F.col("en"), F.col("zh")).alias("v")).collect()]
    assert [(s.id, s.en, s.zh) for s in got[0][0].sentences] == [("block-1-p-0-s-0", "First sentence.", "第一句。"), ("block-1-p-0-s-1", "Second sentence.", "第二句。")]
    assert [(p.en, p.zh) for p in got[1]] == [("One para.", "一段。"), ("Two para.", "二段。")]


def test_surplus_sentences_join_the_last_pair(spark):
    frame = spark.createDataFrame([(["a.", "b."], ["一。", "二。", "三。"])], "en array<string>, zh array<string>")
    assert [x.zh for x in frame.select(P.sentence_pairs(F.col("en"), F.col("zh")).alias("v")).first().v] == ["一。", "二。三。"]


def test_metadata(spark):
    read = lambda name: tuple(one(spark, M.metadata, name))
    assert read("2022年06月大学英语6级真题（卷二）.pdf") == ("2022", "06", "exam", "真题")
    assert read("2022年06月大学英语6级答案解析（卷二）.pdf") == ("2022", "06", "answer", "答案解析")
    assert read("六级听力补充材料.pdf") == ("未识别年份", None, "other", "其他资料")
    assert read("2021年12月真题.pdf")[1] == "01"


def test_hash(spark):
    assert one(spark, T.normalize_for_hash, "  “Hello”   WORLD  ") == '"hello" world'
    assert one(spark, T.text_hash, "Hello world") == one(spark, T.text_hash, " hello   WORLD ")
    assert one(spark, T.normalize_for_hash, "ＡＢ") == "ab"


def test_garbled(spark):
    got = one(spark, Q.quality, "tOOA ½ ~?~?~?~?~?~? □◆ " * 8)
    assert got.garbled and {"known-mojibake", "dense-question-tilde"} <= set(got.reasons)
    assert one(spark, lambda t: Q.wants_ocr(t, Q.quality(t).garbled), "tOOA ½ ~?~?~?~?~?~? □◆ " * 8)


def test_two_columns(spark):
    items = [(1, 0, "A", 50.0, 700.0, 90.0, 12.0), (1, 1, "C", 320.0, 700.0, 94.0, 12.0), (1, 2, "B", 50.0, 680.0, 98.0, 12.0), (1, 3, "D", 320.0, 680.0, 110.0, 12.0)]
    frame = spark.createDataFrame(items, "page int, idx int, text string, x double, y double, width double, height double")
    assert L.page_texts(frame, ["page"]).first().text == "A\nB\nC\nD"


def parsed(spark, *pages):
    frame = spark.createDataFrame([("p", i, text) for i, text in enumerate(pages, 1)], "paper_id string, page_number int, text string")
    return G.blocks_of(G.lines_of(frame)).orderBy("order_index").collect()


def test_questions_without_a_section_open_one(spark):
    got = parsed(spark, "1. What is it?\nA) one B) two\nC) three\nD) four")
    assert [(b.section_type, b.block_type, b.original_text) for b in got] == [("unknown", "question", "1. What is it?"), *(("unknown", "option", x) for x in ("A) one", "B) two", "C) three", "D) four"))]
    got = parsed(spark, "Section A\nsome words\n36. later on\n47. last")
    assert [(b.section_no, b.section_type, b.title) for b in got] == [(0, "unknown", "Section A"), (1, "reading_matching", "长篇匹配"), (2, "reading_careful", "仔细阅读")]


def test_a_section_waits_for_the_word_bank(spark):
    bank = " ".join(f"{chr(75 + i)}) word{'abcde'[i]}" for i in range(5))
    got = parsed(spark, f"Part III Reading Comprehension\nSection A\nA)\naffect\nB) beyond\nSection B\nDirections: You may choose more than once. First part.\n{bank}\nA) Last week.")
    assert [(b.section_type, b.block_type, b.original_text) for b in got[1:3]] == [("reading_bank", "word_bank", "A) affect"), ("reading_bank", "word_bank", "B) beyond")]
    assert [(b.section_type, b.block_type, b.original_text) for b in got[8:]] == [("reading_matching", "directions", "Directions: You may choose more than once."), ("reading_matching", "paragraph", "First part."), ("reading_matching", "paragraph", "A) Last week.")]


def test_a_section_waits_for_option_d(spark):
    got = parsed(spark, "Part II\nListening Comprehension\n(30 minutes)\nSection A\n1.\nA) one\nB) two\nSection B\nC) three\nD) four\nQuestions 9 to 11 are next.")
    assert [(b.section_no, b.option_label or b.block_type) for b in got] == [(0, "heading"), (0, "question"), (0, "A"), (0, "B"), (0, "C"), (0, "D"), (1, "question_group")]


def test_surplus_options_of_late_columns_go_back(spark):
    got = parsed(spark, """Part II
Listening Comprehension
Section B
Questions 9 to 11 are based on the passage you have just heard.
9.
A) Santa Claus.
B) A polar bear.
10.
A) To attract customer attention.
B) To keep up with the times.
C) To combat counterfeits.
D) To promote its sales.
Questions 12 to 15 are based on the passage you have just heard.
13.
A) Social anxiety.
B) Excessive caution.
Questions 16 to 18 are based on the recording you have just heard.
18.
A) They toil on farms.
C) Cocoa seeds.
D) A glass bottle.
C) Lack of social skills.
D) Preference for solitude.
C) They live in Spanish-style houses.
B) They live a poor life.
D) They hire people to do housework.""")
    labels = lambda n: [b.option_label for b in got if b.block_type == "option" and b.question_number == n]
    assert labels(9) == ["A", "B", "C", "D"] and labels(13) == ["A", "B", "C", "D"] and labels(18) == ["A", "C", "B", "D"]
    assert [b.order_index for b in got] == list(range(len(got)))


def test_careful_sections_become_one(spark):
    got = parsed(spark, "Part III\nReading Comprehension\nSection C\nPassage One\n46. first\nA) a1 B) b1 C) c1 D) d1.\nSection C\nPassage Two\nPart I\nWriting\nsome words")
    assert [(b.section_no, b.section_type, b.original_text) for b in got if b.block_type == "heading"] == [(0, "reading_careful", "Part III Reading Comprehension"), (0, "reading_careful", "Passage One"), (0, "reading_careful", "Passage Two"), (1, "writing", "Part I Writing")]


def test_option_repair_against_plain_python(spark):
    """The rule itself over random papers: a list of options per question, changed in place."""
    import random

    random.seed(21)
    rows = []
    for paper in range(40):
        for i in range(random.randint(1, 25)):
            rows.append((paper, random.randint(1, 5), None if (q := random.random() < 0.25) else random.choice("ABCD"), i, q, random.random() < 0.9))
    want = []
    for paper in range(40):
        own = [r for r in rows if r[0] == paper]
        numbers = sorted({r[1] for r in own if r[4]})
        have = {n: [r for r in own if not r[4] and r[1] == n and r[5]] for n in numbers}
        for n in numbers:
            for label in "ABCD":
                have[n, label] = [r for r in have[n] if r[2] == label][:-1]
            for r in sorted(sum((have[n, x] for x in "ABCD"), []), key=lambda r: r[3]):
                have[n].remove(r)
                for m in numbers:
                    if m < n and len(have[m]) < 4 and r[2] not in [x[2] for x in have[m]]:
                        have[m].append(r)
                        break
        want += [(paper, r[3], n) for n in numbers for r in have[n]] + [(paper, r[3], r[1]) for r in own if not r[4] and r[1] not in numbers]
    frame = spark.createDataFrame(rows, "paper_id int, question_number int, option_label string, order_index int, is_question boolean, substantive boolean")
    assert sorted((r.paper_id, r.order_index, r.question_number) for r in G.repaired_options(frame).collect()) == sorted(want)


def test_paper(spark):
    pages = [
        ("p", 1, "Text before any section\nPart II\nListening Comprehension\nSection A\nDirections:\nThen mark the corresponding letter on\nAnswer Sheet 1\nwith a single line through the centre.\nQuestions 1 to 4 are based on the conversation you have just heard."),
        ("p", 2, "1. What did they see?\nA) Santa Claus. B) A polar bear.\nC) She is an acclaimed hostess of\nBook Talk.\nD) A glass bottle."),
        ("p", 3, "Part III Reading Comprehension\nSection B\nA) Last week we met.\nB) The practice goes on.\n36. A question here"),
    ]
    blocks = [r.asDict() for r in G.blocks_of(G.lines_of(spark.createDataFrame(pages, "paper_id string, page_number int, text string"))).orderBy("order_index").collect()]
    assert any("Answer Sheet 1" in b["original_text"] for b in blocks)
    assert {b["section_type"] for b in blocks} == {"listening", "reading_matching"}
    options = [b for b in blocks if b["block_type"] == "option"]
    assert [(b["option_label"], b["question_number"]) for b in options] == [("A", 1), ("B", 1), ("C", 1), ("D", 1)]
    assert options[2]["original_text"] == "C) She is an acclaimed hostess of Book Talk."
    assert blocks[0]["original_text"] == "Part II Listening Comprehension"
    assert [b["original_text"] for b in blocks if b["section_type"] == "reading_matching" and b["block_type"] == "paragraph"] == ["A) Last week we met.", "B) The practice goes on."]
    assert [b["order_index"] for b in blocks] == list(range(len(blocks)))


def test_no_markers_no_sections(spark):
    assert G.blocks_of(G.lines_of(spark.createDataFrame([("p", 1, "only prose\nhere")], "paper_id string, page_number int, text string"))).count() == 0


def test_words_before_an_option_begin_its_section(spark):
    got = parsed(spark, "early words\nA) one\nlate\n2.")
    assert [(b.section_type, b.block_type, b.original_text) for b in got] == [("unknown", "paragraph", "early words"), ("unknown", "option", "A) one late"), ("listening", "question", "2.")]


def test_batches(spark):
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([6000, 400, 200, 7000, 1])], "style string, i int, n int")
    got = {r.i: r.batch for r in O.packed(rows, "style", ["i"], "n").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def test_cache_prefers_own_style(spark):
    blocks = spark.createDataFrame([(1, "h", O.STYLE), (2, "g", O.STYLE), (3, "g", O.PROMPT_STYLE)], "id int, text_hash string, style string")
    cache = spark.createDataFrame([("h", O.STYLE, "new"), ("h", O.LEGACY_STYLE, "old"), ("g", O.LEGACY_STYLE, "old")], "text_hash string, style string, translation string")
    got = {r.id: r.translation for r in O.lookup(blocks, cache, ["id"]).collect()}
    assert got == {1: "new", 2: "old", 3: None}


def test_failing_batch_stamps_its_rows(spark):
    class Fails:
        def translate(self, texts, style):
            if style == "bad":
                raise RuntimeError("down")
            return {k: v.upper() for k, v in texts.items() if v != "skip"}

    rows = spark.createDataFrame([(1, "a", "good", 0), (2, "skip", "good", 0), (3, "b", "bad", 0)], "id int, text string, style string, batch long")
    got = {r.id: (r.translation, r.error) for r in O.translated(rows, Fails(), "id", "text").collect()}
    assert got == {1: ("A", None), 2: (None, "missing"), 3: (None, "RuntimeError: down")}


def test_upsert_and_replace(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 1, "z"), ("c", 0, "w")], "k string, v int, t string")
    assert {r.k: r.t for r in R.upsert(base, new, ["k"], ["v"]).collect()} == {"a": "z", "b": "y", "c": "w"}
    assert {r.k: r.t for r in R.replaced(base, new, "k").collect()} == {"a": "z", "b": "y", "c": "w"}


def test_names(spark):
    assert one(spark, T.safe_name, "__a b/c.pdf__") == "a_b_c.pdf"
    assert one(spark, T.safe_name, "///") == "paper.pdf"
    assert one(spark, T.masked, "sk-123456789") == "sk-1****6789"
    assert one(spark, T.first_object, 'text {"a": {"b": 1}} end') == '{"a": {"b": 1}}'


def test_normalized_lines_agree_in_columns_and_in_walks(spark):
    """Two engines for one table of rewrites, over damaged lines."""
    import random

    random.seed(5)
    parts = ["Part", "1", "Il", "IT", "Ill", " ", "  ", "\u00a0", "fo", "llowing", "f", "our", "Tum", "1s", "“", "’", "A)", "B)x", "12", ".", ",", "!", "?Yes", "Questionsl", "2021 年 12 月英语六级真题 第 1 页 共 11 页", "é", "世", "-", "\u3000"]
    lines = ["".join(random.choice(parts) for _ in range(random.randint(0, 9))) for _ in range(400)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string")
    got = {r.i: (r.n, r.d, r.b) for r in frame.select("i", G.normalize_line(F.col("t")).alias("n"), G.is_fragment(G.normalize_line(F.col("t"))).alias("d"), G.is_fragment(G.normalize_line(F.col("t")), True).alias("b")).collect()}
    assert [got[i] for i in range(len(lines))] == [((n := G.normalized(x)), G.dropped(n), G.dropped(n, True)) for x in lines]


def test_rows_are_numbered_by_ranges(spark):
    frame = spark.range(500).selectExpr("id % 3 AS g", "id * 7 AS k")
    got = sorted((r.g, r.k, r.place, r.total) for r in R.numbered(frame, "g", "k", total="total", span=50).collect())
    groups = {g: [i * 7 for i in range(500) if i % 3 == g] for g in range(3)}
    assert got == [(g, k, i, len(ks)) for g, ks in groups.items() for i, k in enumerate(ks)]


def test_lines_are_normalised_once(spark):
    """Conditions on a line do not rewrite it again; white space is told alike by both engines' classes."""
    import re

    from paperlens.functions.jsregex import ODD_WS, PLAIN_WS, WS

    pages = spark.createDataFrame([("p", 1, "Part  1 x\n12 . A)x\n7\n")], "paper_id string, page_number int, text string")
    lines = G.lines_of(pages).where(G.question_lead(F.col("text")).isNotNull())
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Questionsl|fo") == 1
    assert [(r.line_no, r.text) for r in lines.collect()] == [(1, "12. A) x")]
    signs = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    told = spark.createDataFrame([(c,) for c in signs], "c string").select("c", F.col("c").rlike(rf"\A{WS}\z").alias("ws"), F.col("c").rlike(rf"\A{ODD_WS}\z").alias("odd")).collect()
    assert all(r.ws == bool(re.fullmatch(PLAIN_WS, r.c)) and r.odd == (r.ws and r.c != " ") for r in told)


def test_lines_told_to_be_unchanged(spark):
    """One pass tells the lines that no rewrite changes; every other one is rewritten as before."""
    from paperlens.operators import grammar as G

    signs = "\t\n\r\x0b\x00\x7f\x80\xa0\xa1\xffſKé ᚁ ​‘’‚“”„  ‰ ⁠　、年中﻾﻿！😀"
    lines = [f"a{chr(i)}{after}" for i in range(32, 127) for after in ("", "b", "C", ")", " ", ".", "um", "s", "art x", "o  llowing", " our", "uestionsl")]
    lines += [f"{x}{c}{y}" for c in signs for x in ("", "a") for y in ("", "b")] + ["", " ", "12 .", "1 .x", "a 1 .x", "Part 1", "PART  Ill", "see fo llowing", "F our", "Turn Tum", "a  b", "3.5", "“x”", "A)b", "P)b", "end. ", " x"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", G.normalize_line(F.col("line")).alias("made"), F.col("line").rlike(G.UNCHANGED).alias("same")).collect()
    assert [(r.line, r.made) for r in rows] == [(x, G.normalized(x)) for x in lines]
    assert all(r.line == r.made for r in rows if r.same)


def test_items_are_parsed_once(spark):
    """However many fields of an item are asked for, its string is parsed once."""
    rows = spark.createDataFrame([("a", 1.5), (None, 2.0)], "t string, h double")
    json = F.to_json(F.struct(F.col("t").alias("str"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.col("h"), F.lit(4.0), F.lit(5.0)).alias("transform")))
    items = rows.select(L.items_from_json(json).alias("i")).select("i.text", "i.x", "i.y", "i.height")
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert [tuple(r) for r in items.collect()] == [("a", 4.0, 5.0, 1.5), (None, None, None, None)]
