"""Reading order of positioned text items: columns and neighbours by windows, line clusters per page.

Clustering items into lines is sequential (each line's height moves with its members), and so is an order that is not total; both
walk the numbers of a page's items or lines, which lie in arrays of the page's row. Everything around it is windows and aggregates.
"""

from __future__ import annotations

import functools
import statistics

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlens.functions.jsregex import named
from paperlens.operators.grouped import walked
from paperlens.sources.files import bounded

ITEM = "struct<str:string,transform:array<double>,width:double,height:double,hasEOL:boolean>"
#: Widest gap within a line, least and relative gap between columns, distance of equal heights.
LINE_GAP, COLUMN_GAP, COLUMN_SHARE, LEVEL = 72, 48, 0.18, 2
NO_BLANK_BEFORE, NO_BLANK_AFTER = r"\A[\s,.;:!?%)\]}]", r"[\s(\[{]\z"


def finite(c: Column) -> Column:
    c = F.nanvl(c, F.lit(0.0))
    return F.when(c.isNull() | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def items_from_json(json: Column) -> Column:
    """A struct of text, x, y, width, height, has_transform, has_eol; null without a string."""
    def read(item: Column) -> Column:
        whole = F.coalesce(F.size(item["transform"]) >= 6, F.lit(False))
        at = lambda i: F.when(whole, finite(F.get(item["transform"], F.lit(i)))).otherwise(0.0)
        height = F.when(finite(item["height"]) > 0, finite(item["height"])).otherwise(F.abs(at(3)))
        return F.when(
            item["str"].isNotNull(),
            F.struct(item["str"].alias("text"), at(4).alias("x"), at(5).alias("y"), finite(item["width"]).alias("width"), height.alias("height"), whole.alias("has_transform"), F.coalesce(item["hasEOL"], F.lit(False)).alias("has_eol")),
        )

    # The string is parsed once, and what comes out of an array is not made again for each of its fields.
    return named(F.from_json(json, ITEM), read)


def tolerance(items: DataFrame, page: list[str]) -> DataFrame:
    """Per page the vertical distance within a line: 0.65 of the median positive height, at least 2."""
    median = F.percentile(F.when(F.col("height") > 0, F.col("height")), 0.5)
    return items.groupBy(*page).agg(F.greatest(F.lit(2.0), F.coalesce(0.65 * median, F.lit(0.0))).alias("tolerance"))


def columns_of(lines: DataFrame, page: list[str]) -> DataFrame:
    """lines (page, x, order) with column 0 or 1: parted at the widest gap if it is wide enough and both sides have two lines."""
    w = Window.partitionBy(*page).orderBy("x", "order")
    gaps = lines.withColumns({"gap": F.lead("x").over(w) - F.col("x"), "next": F.lead("x").over(w), "rank": F.row_number().over(w)})
    whole = Window.partitionBy(*page)
    best = gaps.withColumns(
        {
            "n": F.count("*").over(whole), "range": F.max("x").over(whole) - F.min("x").over(whole),
            "best": F.max_by(F.struct("gap", "x", "next", "rank"), F.struct(F.coalesce("gap", F.lit(-1.0)), -F.col("rank"))).over(whole),
        }
    )
    wide = (F.col("n") >= 4) & (F.col("best.rank") >= 2) & (F.col("n") - F.col("best.rank") >= 2) & (F.col("best.gap") >= F.greatest(F.lit(float(COLUMN_GAP)), COLUMN_SHARE * F.greatest(F.col("range"), F.lit(1.0))))
    split = F.when(wide, (F.col("best.x") + F.col("best.next")) / 2)
    return best.withColumn("column", F.when(F.col("x") >= split, 1).otherwise(0)).select(*lines.columns, "column")


def char_width(text: Column, width: Column) -> Column:
    visible = F.char_length(F.translate(text, " \t\n\x0b\f\r", ""))
    return F.when((visible > 0) & (width > 0), width / visible)


def joined_line(items: DataFrame, line: list[str]) -> DataFrame:
    """line and its text: items by x, a blank where the gap exceeds 0.45 of a character and no blank or sign forbids it."""
    w = Window.partitionBy(*line).orderBy("x", F.desc("y"), "idx")
    before = F.lag(F.struct("text", "x", "width")).over(w)
    rows = items.withColumn("before", before)
    own, prior = char_width(F.col("text"), F.col("width")), char_width(F.col("before.text"), F.col("before.width"))
    typical = F.coalesce((own + prior) / 2, own, prior, F.lit(0.0))
    gap = F.col("x") - (F.col("before.x") + F.col("before.width"))
    free = (F.col("text") != "") & (F.col("before.text") != "") & ~F.col("text").rlike(NO_BLANK_BEFORE) & ~F.col("before.text").rlike(NO_BLANK_AFTER)
    blank = F.coalesce(free & (gap > 0) & (gap > F.greatest(F.lit(1.5), 0.45 * typical)), F.lit(False))
    rows = rows.withColumn("part", F.concat(F.when(blank, " ").otherwise(""), F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("x", (-F.col("y")).alias("y"), "idx", "part")))
    return rows.groupBy(*line).agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("max_x"), F.array_join(F.transform(ordered, lambda i: i.part), "").alias("text"))


def _flat(lists: pa.Array) -> list:
    """The elements of all lists; null numbers are NaN."""
    return lists.flatten().to_numpy(zero_copy_only=False).tolist()


def _ends(lists: pa.Array) -> list[int]:
    return [0, *lists.value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()]


def _lists(ends: list[int], **columns: list) -> pa.Array:
    """A struct of lists that are cut at these ends."""
    offsets = pa.array(ends, pa.int32())
    kinds = {k: pa.float64() if k == "line_y" else pa.int32() for k in columns}
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(c, kinds[k])) for k, c in columns.items()], list(columns))


def _first_fit(x: list[float], y: list[float], width: list[float], height: list[float]) -> tuple[list[int], list[float]]:
    """Line of each item and height of each line, items from top to bottom."""
    heights = [h for h in height if h > 0]
    most = max(2.0, 0.65 * statistics.median(heights)) if heights else 2.0
    at, tops = [], []
    near: list[list] = []  # line, y, left, right, members; of the lines that an item may still join
    for x_, y_, w in zip(x, y, width, strict=True):
        end = x_ + w
        for line in near:
            _, ly, left, right, n = line
            if abs(ly - y_) <= most and (x_ - right if x_ >= right else left - end) <= LINE_GAP:
                line[1:] = (ly * n + y_) / (n + 1), min(left, x_), max(right, end), n + 1
                break
        else:
            # Items only go down and a line moves with its members alone: what is too far above stays so.
            near = [line for line in near if not line[1] - y_ > most]
            line = [len(tops), y_, x_, end, 1]
            near.append(line)
            tops.append(y_)
        at.append(line[0])
        tops[line[0]] = line[1]
    return at, tops


def clustered(items: DataFrame, page: list[str]) -> DataFrame:
    """items (page, idx, x, y, width, height and more) with line (its number) and line_y: first fit, from top to bottom.
    A page's items lie in one row while their numbers are walked."""
    inner = [c for c in items.columns if c not in page]

    def cluster(*columns: pa.Array) -> pa.Array:
        parts, offsets = [_flat(c) for c in columns], _ends(columns[0])
        lines, tops, begun = [], [], 0
        for end in offsets[1:]:
            at, heights = _first_fit(*(p[begun:end] for p in parts))
            lines += at
            tops += [heights[k] for k in at]
            begun = end
        return _lists(offsets, line=lines, line_y=tops)

    found = F.arrow_udf(cluster, "line array<int>, line_y array<double>")
    item = F.struct((-F.col("y")).alias("down"), F.col("x").alias("across"), F.col("idx").alias("nth"), F.struct(*inner).alias("item"))
    packed = bounded(items).groupBy(*page).agg(F.array_sort(F.collect_list(item))["item"].alias("items"))
    placed = packed.withColumn("at", found(*(F.col("items")[c].cast("array<double>") for c in ("x", "y", "width", "height"))))
    rows = placed.select(*page, F.inline(F.arrays_zip("items", F.col("at.line").alias("line"), F.col("at.line_y").alias("line_y"))))
    return rows.select(*(F.col(c) if c in page else F.col("items")[c].alias(c) for c in items.columns), "line", "line_y")


def _earlier(a: tuple, b: tuple) -> int:
    """Lines by column, y, x and line. Heights within 2 count as equal, which is no total order."""
    if a[0] != b[0]:
        return a[0] - b[0]
    keys = (a[2] - b[2], a[3] - b[3]) if abs(a[1] - b[1]) <= LEVEL else (b[1] - a[1], a[2] - b[2], a[3] - b[3])
    return next((1 if k > 0 else -1 for k in keys if k), 0)


def ordered_lines(lines: DataFrame, page: list[str]) -> DataFrame:
    """lines (page, line, column, x, y, text) with place; each page is sorted by comparison."""
    rows = lines.select(*page, "line", "column", "x", "y", "text")
    out = rows.select(*page, "line", "text").withColumn("place", F.lit(0)).schema

    def order(group: list) -> list[tuple]:
        key = functools.cmp_to_key(_earlier)
        found = sorted(group, key=lambda r: key((r.column, r.y, r.x, r.line)))
        return [(*(getattr(r, c) for c in page), r.line, r.text, i) for i, r in enumerate(found)]

    return walked(rows, page, [F.asc("line")], order, out)


def _split(lefts: list[float]) -> float | None:
    """Where columns_of parts a page whose lines begin at these x."""
    at = sorted(lefts)
    n = len(at)
    if n < 4:
        return None
    k = max(range(n - 1), key=lambda i: at[i + 1] - at[i])  # the first of the widest gaps
    gap = at[k + 1] - at[k]
    wide = 1 <= k <= n - 3 and gap >= max(COLUMN_GAP, COLUMN_SHARE * max(at[-1] - at[0], 1.0))
    return (at[k] + at[k + 1]) / 2 if wide else None


def _reading(x: list, y: list, width: list, height: list, typical: list, starts: list, ends: list) -> tuple[list[int], list[int]]:
    """A page's items in reading order, and what stands before each: nothing (0), a blank (1), a new line (2)."""
    at, tops = _first_fit(x, y, width, height)
    lines: list[list[int]] = [[] for _ in tops]
    for i, k in enumerate(at):
        lines[k].append(i)
    for line in lines:
        line.sort(key=x.__getitem__)  # items of one x stay from top to bottom
    lefts = [x[line[0]] for line in lines]
    split = _split(lefts)
    order = range(len(lines))
    if len(lines) > 1:
        key = functools.cmp_to_key(_earlier)
        order = sorted(order, key=lambda k: key((int(split is not None and lefts[k] >= split), tops[k], lefts[k], k)))
    items, leads = [], []
    for k in order:
        before = None
        for i in lines[k]:
            lead = 2
            if before is not None:
                gap, lead = x[i] - (x[before] + width[before]), 0
                if gap > 1.5 and starts[i] and ends[before]:
                    own, prior = typical[i], typical[before]  # NaN: none
                    usual = (own + prior) / 2 if own == own and prior == prior else own if own == own else prior if prior == prior else 0.0
                    lead = int(gap > 0.45 * usual)
            items.append(i)
            leads.append(lead)
            before = i
    if leads:
        leads[0] = 0
    return items, leads


def page_texts(items: DataFrame, page: list[str], **more: Column) -> DataFrame:
    """page and its text in reading order, one line a row of text. items: page, idx, text, x, y, width, height; a row without idx is no item,
    and a page without items has an empty text. more: aggregates of a page's rows.

    The same text as clustered, joined_line, columns_of and ordered_lines give one after another; here a page is one row
    from the first exchange on, the numbers of its items are walked in batches of pages, and texts are joined by Spark."""
    text = F.coalesce("text", F.lit(""))
    item = F.struct(
        (-F.col("y")).alias("down"), "x", "idx", "width", "height", char_width(text, F.col("width")).alias("typical"),
        ((text != "") & ~text.rlike(NO_BLANK_BEFORE)).alias("starts"), ((text != "") & ~text.rlike(NO_BLANK_AFTER)).alias("ends"), text.alias("text"),
    )

    def read(*columns: pa.Array) -> pa.Array:
        x, down, *rest = [_flat(c) for c in columns]
        parts = [x, [-d for d in down], *rest]
        order, leads, begun, offsets = [], [], 0, _ends(columns[0])
        for end in offsets[1:]:
            own, before = _reading(*(p[begun:end] for p in parts))
            order += own
            leads += before
            begun = end
        return _lists(offsets, order=order, lead=leads)

    found = F.arrow_udf(read, "order array<int>, lead array<int>")
    packed = bounded(items).groupBy(*page).agg(F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), item))).alias("items"), *(c.alias(n) for n, c in more.items()))
    placed = packed.withColumn("at", found(*(F.col("items")[c] for c in ("x", "down", "width", "height", "typical", "starts", "ends"))))
    lead = F.array(F.lit(""), F.lit(" "), F.lit("\n"))
    parts = F.zip_with("at.order", "at.lead", lambda i, k: F.concat(F.get(lead, k), F.get("items", i)["text"]))
    return placed.select(*page, F.array_join(parts, "").alias("text"), *more)


def _most(height: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Vertical distance within a line, a page each: as tolerance() has it."""
    least, most = np.minimum.reduceat(np.where(height > 0, height, np.inf), begins), np.maximum.reduceat(np.where(height > 0, height, -np.inf), begins)
    for i in np.flatnonzero(least < most):
        some = height[begins[i] : ends[i]]
        least[i] = statistics.median(some[some > 0].tolist())
    return np.where(np.isinf(least), 2.0, np.maximum(2.0, 0.65 * least))


def texts(texts: pa.Array, *numbers: pa.Array) -> pa.Array:
    """Text of each page in reading order, from lists of its items' texts, x, y, width and height: what page_texts gives, of Arrow arrays.

    Pages are laid out together where no step depends on the one before: heights of items are either equal or too far apart for one line, a mean
    of equal heights is exact, and items of one height do not lie within others. All other pages are walked one by one."""
    offsets = np.concatenate([[0], texts.value_lengths().to_numpy(zero_copy_only=False)]).cumsum()
    if not offsets[-1]:
        return pa.array([""] * len(texts), pa.string())
    x, y, width, height = (np.where(np.isfinite(v), v, 0.0) for v in (c.flatten().to_numpy(zero_copy_only=False) for c in numbers))
    page = np.repeat(np.arange(len(texts)), np.diff(offsets))
    begins = offsets[:-1][np.diff(offsets) > 0]
    ends = np.append(begins[1:], offsets[-1])
    nth = np.repeat(np.arange(len(begins)), ends - begins)
    order = np.lexsort((x, -y, page))  # items of one place stay in their order
    x, y, width, height = (v[order] for v in (x, y, width, height))

    words = texts.flatten().fill_null("").dictionary_encode()
    codes, words = words.indices.to_numpy()[order], words.dictionary
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    starts = some & ~pc.is_in(pc.utf8_slice_codeunits(words, 0, 1), pa.array(list(" \t\n\x0b\f\r,.;:!?%)]}"))).to_numpy(zero_copy_only=False)
    stops = some & ~pc.is_in(pc.utf8_slice_codeunits(words, -1), pa.array(list(" \t\n\x0b\f\r([{"))).to_numpy(zero_copy_only=False)
    visible = pc.subtract(pc.utf8_length(words), pc.count_substring_regex(words, "[ \\t\\n\\x0b\\f\\r]")).to_numpy(zero_copy_only=False)
    starts, stops, visible = starts[codes], stops[codes], visible[codes]
    typical = np.where((visible > 0) & (width > 0), width / np.maximum(visible, 1), np.nan)

    def before(v: np.ndarray) -> np.ndarray:
        return np.concatenate([v[:1], v[:-1]])

    first = np.zeros(len(x), bool)
    first[begins] = True
    level, end = ~first & (y == before(y)), x + width
    gap = x - before(end)
    even = (np.abs(y) < 2**20) & (y * 1024 == np.floor(y * 1024)) & (width >= 0) & (first | level | (before(y) - y > _most(height, begins, ends)[nth])) & (~level | (end >= before(end)))
    even = np.logical_and.reduceat(even, begins) & (ends - begins < 2**20)
    new = ~level | (gap > LINE_GAP)
    prior = before(typical)
    usual = np.where(np.isnan(typical), np.where(np.isnan(prior), 0.0, prior), np.where(np.isnan(prior), typical, (typical + prior) / 2))
    lead = np.where(new, 2, (gap > 1.5) & starts & before(stops) & (gap > 0.45 * usual))
    lead[begins] = 0
    place = np.arange(len(x))

    least, most = np.minimum.reduceat(np.where(new, x, np.inf), begins), np.maximum.reduceat(np.where(new, x, -np.inf), begins)
    for i in np.flatnonzero(even & (most - least >= COLUMN_GAP)):  # else there is no gap that parts columns
        at = slice(begins[i], ends[i])
        lefts = x[at][new[at]]
        split = _split(lefts.tolist())
        if split is not None:
            right = (lefts >= split)[new[at].cumsum() - 1]
            lead[begins[i]] = 2
            moved = np.argsort(right, kind="stable")
            place[at], lead[at] = begins[i] + moved, lead[at][moved]
            lead[begins[i]] = 0
    for i in np.flatnonzero(~even):
        at = slice(begins[i], ends[i])
        items, leads = _reading(*(v[at].tolist() for v in (x, y, width, height, typical, starts, stops)))
        place[at], lead[at] = begins[i] + np.array(items), leads

    parts = pc.binary_join_element_wise(pa.array(["", " ", "\n"]).take(pa.array(lead.astype(np.int32))), words.take(pa.array(codes[place])), "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), parts), "")
