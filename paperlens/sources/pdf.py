"""PDF files as a Spark data source: text items of pages out, rows of lines in.

Reading: read() and pages() have tasks list the files and deal them out; as a data source (format "pdf") the driver lists files and
their sizes, and small files share a partition. A large one is cut into shares of its pages, and a task finds its share through the file's cross-reference (tables, streams and compressed objects), so it reads the
objects of its own pages and no others. A file without a usable cross-reference is searched for its objects. A file that cannot be read
becomes one row with an error and page 0, a page that cannot be read one with its number; a page without text is a row without an item.
arriving() gives the same rows for files that come into a folder, by Spark's own file stream.

Writing: one file per row (name, pages: lines of each), words as text items at equal pitch, the words of a line shown together. The bytes depend on the lines
alone, so a task that runs again writes the same file. Rows with the same name overwrite each other.
"""

from __future__ import annotations

import functools
import io
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from paperlens.sources.listing import pdfs, place, tasks

SPLIT_BYTES, BATCH_ITEMS = 16 << 20, 5_000
#: A gap beyond so many thousandths parts items.
FAR = 100
SCHEMA = "file string, page_number int, idx int, str string, transform array<double>, width double, height double, error string"
PAGES = "file string, page_number int, str array<string>, x array<double>, y array<double>, width array<double>, height array<double>, error string"
_ARROW = pa.schema([("file", pa.string()), ("page_number", pa.int32()), ("idx", pa.int32()), ("str", pa.string()), ("transform", pa.list_(pa.float64())), ("width", pa.float64()), ("height", pa.float64()), ("error", pa.string())])
#: Layout of written pages, in points: size of the type, pitch of characters and lines, left and top edge.
TYPE, PITCH, LEADING, LEFT, TOP = 10, 5, 14, 50, 780


class Name(str):
    """A PDF name."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    about: dict
    raw: bytes


_TOKEN = re.compile(rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+)*+(<<|>>|[\[\]{}]|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\x00\t\n\x0c\r ]*>|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)")
# The same, and before it the numbers that blanks part: the operands of most operators.
_STEP = re.compile(_TOKEN.pattern.replace(rb"*+(<<", rb"*+((?:[+-]?(?:\d+\.?\d*|\.\d+)[\t\n\x0c\r ]++)*+)(<<"))
# The most common operators of all, a place and a text there, in one step.
_REAL, _BLANK = rb"[+-]?(?:\d+\.?\d*|\.\d+)", rb"[\t\n\x0c\r ]"
_SHOWN = re.compile(rb"%b*+((?:%b%b++){3}%b)%b++(%b)%b++(%b)%b++Tm%b++(<[0-9A-Fa-f]*+>)%b*+Tj(?=%b)" % (_BLANK, _REAL, _BLANK, _REAL, _BLANK, _REAL, _BLANK, _REAL, _BLANK, _BLANK, _BLANK, _BLANK))
# Many of them after each other, all with the same four numbers and parted by blanks: nine words each.
_RUN = re.compile(rb"%b*+((?:%b%b++){4})%b%b++%b%b++Tm%b++<[0-9A-Fa-f]*+>%b++Tj(?=%b)(?:%b++\1%b%b++%b%b++Tm%b++<[0-9A-Fa-f]*+>%b++Tj(?=%b)){3,}+" % (_BLANK, *[_REAL, _BLANK] * 3, _BLANK, _BLANK, _BLANK, _BLANK, *[_REAL, _BLANK] * 2, _BLANK, _BLANK, _BLANK))
# Lines after each other, all with the same four numbers: a place, and strings in hexadecimal digits with a number between each two.
_ROW = rb"%b%b++%b%b++Tm%b*+\[%b*+<[0-9A-Fa-f]*+>(?:%b++%b%b++<[0-9A-Fa-f]*+>)*+%b*+\]%b*+TJ(?=%b)" % (_REAL, _BLANK, _REAL, _BLANK, _BLANK, _BLANK, _BLANK, _REAL, _BLANK, _BLANK, _BLANK, _BLANK)
_ROWS = re.compile(rb"%b*+((?:%b%b++){4})%b(?:%b++\1%b)*+" % (_BLANK, _REAL, _BLANK, _ROW, _BLANK, _ROW))
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_OBJECT = re.compile(rb"%b*+(\d++)%b++\d++%b++obj(?=[\x00\t\n\x0c\r <\[(/])" % (_BLANK, _BLANK, _BLANK))
_STREAM = re.compile(rb"\s*stream\r?\n")
_CHARS = re.compile(rb"\s*+(?:<[0-9A-Fa-f]{4}>\s*+<[0-9A-Fa-f]{4}>\s*+)*+")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_WORDS = {b"true": True, b"false": False, b"null": None}


class Operator(bytes):
    """A word that is no value."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string that begins behind an opening parenthesis, and where it ends."""
    out, depth = [], 1
    for m in re.compile(rb"\\([0-7]{1,3}|\r\n|.)|([()])|[^\\()]+", re.S).finditer(data, at):
        if m[1]:
            out.append(bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1] in (b"\n", b"\r", b"\r\n") else _ESCAPED.get(m[1], m[1]))
            continue
        depth += {b"(": 1, b")": -1}.get(m[2], 0)
        if not depth:
            return b"".join(out), m.end()
        out.append(m[0])
    raise ValueError("a string without an end")


@functools.lru_cache(4096)
def _name(raw: bytes) -> Name:
    if b"#" not in raw:
        return Name(raw.decode("latin-1"))
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"))


def _hex(token: bytes) -> bytes:
    try:
        return bytes.fromhex(token[1:-1].decode())
    except ValueError:  # an odd digit, or blanks within bytes
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators from a place on, each with where it ends. References are made where two numbers and R follow each other."""
    open_: list[list] = []

    def closed(items: list) -> object:
        return items[1:] if items[0] == b"[" else {k: v for k, v in zip(items[1::2], items[2::2], strict=False)}

    while m := _TOKEN.match(data, at):
        token, at = m[1], m.end()
        if token in (b"[", b"<<"):
            open_.append([token])
            continue
        if token in (b"]", b">>"):
            if not open_:
                return
            value = closed(open_.pop())
        elif token.isdigit():
            value = int(token)
        elif token == b"(":
            value, at = _literal(data, at)
        elif token[:1] == b"/":
            value = _name(token[1:])
        elif token[:1] == b"<":
            value = _hex(token)
        elif _NUMBER.fullmatch(token):
            value = float(token) if b"." in token else int(token)
        elif token == b"R" and open_ and len(open_[-1]) > 2:
            open_[-1][-2:] = [Ref(open_[-1][-2])]
            continue
        else:
            value = _WORDS[token] if token in _WORDS else Operator(token)
        if open_:
            open_[-1].append(value)
            continue
        yield value, at


def _lines(block: bytes) -> tuple[list, list, list] | None:
    """x and y of lines, and of each its strings and the numbers between them; none if one of these does not part items."""
    xs, ys, rows = [], [], []
    for text in block.split(b"TJ")[:-1]:
        head, body = text.split(b"[")
        *_, x, y, _ = head.split()
        words = body[: body.index(b"]")].split()
        xs.append(x)
        ys.append(y)
        rows.append((words[::2], words[1::2]))
    if any(abs(float(gap)) <= FAR for gap in set().union(*(gaps for _, gaps in rows))):
        return None
    return xs, ys, rows


def operations(data: bytes) -> Iterator[tuple[bytes, list]]:
    """Operators of a page's content, each with its operands: what values() finds, with one step for a run of numbers. Numbers are floats.
    A place and a text there come as one operator, Tm Tj, whose operands are not read yet: four numbers, x, y, codes. Four or more of
    these with the same numbers come as one, Tm Tj Tm Tj: the numbers, and lists of x, y and codes. Lines of strings in
    hexadecimal digits that are far apart come as one, Tm TJ Tm TJ: the numbers, lists of x and y, and each line's codes and gaps."""
    args, at = [], 0
    rows, run, shown, step = _ROWS.match, _RUN.match, _SHOWN.match, _STEP.match
    while True:
        if (m := rows(data, at)) and (lines := _lines(m[0])):
            yield b"Tm TJ Tm TJ", [m[1], *lines]
            args, at = [], m.end()
            continue
        if m := run(data, at):
            words = m[0].split()
            yield b"Tm Tj Tm Tj", [m[1], words[4::9], words[5::9], words[7::9]]
            args, at = [], m.end()
            continue
        if m := shown(data, at):
            yield b"Tm Tj", m.groups()
            args, at = [], m.end()
            continue
        if not (m := step(data, at)):
            return
        numbers, token = m.groups()
        at = m.end()
        if numbers:
            args += map(float, numbers.split())
        match token[0]:
            case 0x3C if len(token) != 2 or token == b"<>":
                args.append(_hex(token))
            case 0x28:
                value, at = _literal(data, at)
                args.append(value)
            case 0x2F:
                args.append(_name(token[1:]))
            case 0x3C | 0x5B:  # a dictionary or an array
                value, at = next(values(data, m.start(2)), (None, None))
                if at is None:
                    return
                args.append(value)
            case 0x3E | 0x5D:
                return
            case _:
                if _NUMBER.fullmatch(token):
                    args.append(float(token))
                elif token in _WORDS:
                    args.append(_WORDS[token])
                else:
                    yield token, args
                    args = []


def inflated(stream: Stream, resolve) -> bytes:
    data, filters, parms = stream.raw, resolve(stream.about.get("Filter")) or [], resolve(stream.about.get("DecodeParms")) or {}
    for i, kind in enumerate(filters if isinstance(filters, list) else [filters]):
        if kind in ("FlateDecode", "Fl"):
            data = zlib.decompressobj().decompress(data)
        elif kind in ("ASCIIHexDecode", "AHx"):
            data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]|>.*", b"", data, flags=re.S).decode())
        else:
            raise ValueError(f"filter {kind} is not read")
        own = resolve(parms[i] if isinstance(parms, list) else parms) or {}
        if own.get("Predictor", 1) >= 10:
            data = _unpredicted(data, own.get("Columns", 1) * own.get("Colors", 1) * own.get("BitsPerComponent", 8) // 8, max(1, own.get("Colors", 1) * own.get("BitsPerComponent", 8) // 8))
    return data


def _unpredicted(data: bytes, width: int, pixel: int) -> bytes:
    """Rows of PNG predictors undone."""
    out, above = bytearray(), bytes(width)
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(width):
            left, corner = (row[i - pixel], above[i - pixel]) if i >= pixel else (0, 0)
            guess = left + above[i] - corner
            nearest = min((left, above[i], corner), key=lambda v: abs(guess - v))
            row[i] = (row[i] + (0, left, above[i], (left + above[i]) // 2, nearest)[kind]) & 255
        out += row
        above = bytes(row)
    return bytes(out)


class Pdf:
    """Objects and pages of a file that can be read at any place."""

    def __init__(self, source):
        self.source = source
        self.size = source.seek(0, 2) if isinstance(source, io.BytesIO) else source.size()
        self.places: dict[int, tuple[int, int | None]] = {}  # an offset, or a stream of objects and a place in it
        self.trailer: dict = {}
        self.unpacked: dict[int, list] = {}
        self.fonts: dict[int, Font] = {}
        self.branches: dict[int, dict] = {}  # nodes of the page tree that have kids
        self.leaves: dict[int, int] = {}  # how many pages the others stand for
        self.searched = False
        try:
            start = re.findall(rb"startxref\s+(\d+)", self._read(max(0, self.size - 2048), 2048))
            self._cross_references(int(start[-1]))
            self.count = self.resolve(self.resolve(self.resolve(self.trailer["Root"])["Pages"])["Count"])
        except Exception:  # noqa: BLE001  whatever is wrong with it, the objects themselves can still be there
            self._search()
            self.count = self.resolve(self.resolve(self.resolve(self.trailer["Root"])["Pages"])["Count"])
        if "Encrypt" in self.trailer:
            raise ValueError("the file is encrypted")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _cross_references(self, at: int) -> None:
        seen = set()
        while at is not None and at not in seen:
            seen.add(at)
            head = self._read(at, 1 << 16)
            if head.lstrip().startswith(b"xref"):
                while b"trailer" not in head or not re.search(rb"trailer.*startxref", head, re.S):
                    more = self._read(at + len(head), 1 << 20)
                    if not more:
                        break
                    head += more
                table, rest = head.split(b"trailer", 1)
                numbers = table.split()[1:]
                while numbers:
                    first, n = int(numbers[0]), int(numbers[1])
                    for i in range(n):
                        offset, _, kind = numbers[2 + 3 * i : 5 + 3 * i]
                        if kind == b"n":
                            self.places.setdefault(first + i, (int(offset), None))
                    numbers = numbers[2 + 3 * n :]
                about = next(values(rest))[0]
            else:
                stream = self._object_at(at)
                about, data = stream.about, inflated(stream, lambda x: x)
                widths = about["W"]
                ranges = about.get("Index", [0, about["Size"]])
                place = 0
                for first, n in zip(ranges[::2], ranges[1::2], strict=True):
                    for number in range(first, first + n):
                        row = []
                        for w in widths:
                            row.append(int.from_bytes(data[place : place + w], "big") if w else None)
                            place += w
                        kind = 1 if row[0] is None else row[0]
                        if kind == 1:
                            self.places.setdefault(number, (row[1], None))
                        elif kind == 2:
                            self.places.setdefault(number, (row[1], row[2] or 0))
            self.trailer = {**about, **self.trailer}
            at = about.get("XRefStm", about.get("Prev"))

    def _search(self) -> None:
        """Objects by their marks, for files whose cross-reference is damaged."""
        self.places, self.trailer, self.unpacked, self.searched = {}, {}, {}, True
        self.fonts, self.branches, self.leaves = {}, {}, {}
        data = self._read(0, self.size)
        for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", data):
            self.places[int(m[1])] = (m.start(), None)
        for m in re.finditer(rb"\btrailer\b", data):
            self.trailer |= next(values(data, m.end()), ({},))[0]
        for number in list(self.places):
            found = self.get(number)
            about = found.about if isinstance(found, Stream) else found
            kind = about.get("Type") if isinstance(about, dict) else None
            if kind == "Catalog":
                self.trailer.setdefault("Root", Ref(number))
            elif kind == "ObjStm":
                for i, inner in enumerate(self._packed(number)[0]):
                    self.places.setdefault(inner, (number, i))
        if "Root" not in self.trailer:
            raise ValueError("no catalogue of pages")

    def _object_at(self, at: int, number: int | None = None):
        size = 1 << 14
        while True:
            data = self._read(at, size)
            if head := _OBJECT.match(data):
                found = [(int(head[1]), 0), (0, 0), (b"obj", 0), *_first(values(data, head.end()), 1)]
            else:
                found = list(_first(values(data), 4))
            if len(found) == 4 or len(data) < size:
                break
            size *= 4
        if len(found) < 4 or found[2][0] != b"obj" or number not in (None, found[0][0]):
            raise ValueError(f"no object at byte {at}")
        value, end = found[3]
        head = _STREAM.match(data, end)
        if not isinstance(value, dict) or not head:
            return value
        return Stream(value, self._read(at + head.end(), self.resolve(value["Length"])))

    def _packed(self, number: int) -> tuple[list[int], list]:
        """Numbers and values of the objects in a stream of objects."""
        if number not in self.unpacked:
            stream = self.get(number)
            data, n, first = inflated(stream, self.resolve), stream.about["N"], stream.about["First"]
            heads = [int(x) for x in data[:first].split()][: 2 * n]
            self.unpacked[number] = heads[::2], [next(values(data, first + at))[0] for at in heads[1::2]]
        return self.unpacked[number]

    def get(self, number: int):
        at, inner = self.places.get(number, (None, None))
        if at is None:
            return None
        if inner is not None:
            return self._packed(at)[1][inner]
        try:
            return self._object_at(at, number)
        except ValueError:
            if self.searched:
                raise
        self._search()  # the cross-reference is wrong
        return self.get(number)

    def resolve(self, value):
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.get(value.number)
        raise ValueError("references in a circle")

    def _node(self, ref) -> dict:
        """A node of the page tree; those with kids are read once."""
        number = ref.number if isinstance(ref, Ref) else None
        if number in self.branches:
            return self.branches[number]
        node = self.resolve(ref)
        if "Kids" in node:
            node = {**node, "Kids": self.resolve(node["Kids"]), "Count": self.resolve(node.get("Count", 1))}
            if number is not None:
                self.branches[number] = node
        return node

    def page(self, i: int) -> dict:
        """The page by its place from 0, with what it inherits."""
        node, inherited = self._node(self._node(self.trailer["Root"])["Pages"]), {}
        while "Kids" in node:
            inherited |= {k: node[k] for k in ("Resources",) if k in node}
            for ref in node["Kids"]:
                number = ref.number if isinstance(ref, Ref) else None
                if i >= self.leaves.get(number, i + 1):  # a page before, seen already
                    i -= self.leaves[number]
                    continue
                kid = self._node(ref)
                n = kid["Count"] if "Kids" in kid else 1
                if "Kids" not in kid and number is not None:
                    self.leaves[number] = n
                if i < n:
                    node = kid
                    break
                i -= n
            else:
                raise ValueError("fewer pages than counted")
        return inherited | node

    def content(self, page: dict) -> bytes:
        parts = self.resolve(page.get("Contents"))
        return b"\n".join(inflated(self.resolve(p), self.resolve) for p in (parts if isinstance(parts, list) else [parts]) if p is not None)


def _first(found: Iterator, n: int) -> Iterator:
    for _, x in zip(range(n), found, strict=False):
        yield x


class _Known(dict):
    """For str.translate: what is not there has no text."""

    def __missing__(self, code: int) -> None:
        return None


class Font:
    """Texts and widths (in thousandths) of a font's codes."""

    def __init__(self, pdf: Pdf, about: dict):
        self.wide = about.get("Subtype") == "Type0"
        self.texts = _unicode(inflated(pdf.resolve(about["ToUnicode"]), pdf.resolve)) if "ToUnicode" in about else {}
        self.table = _Known(self.texts)
        self.single = all(len(text) == 1 for text in self.texts.values())
        self.widths, self.default = {}, 500
        self.known: dict[bytes, tuple] = {}
        if self.wide:
            inner = pdf.resolve(pdf.resolve(about["DescendantFonts"])[0])
            self.default, rows = inner.get("DW", 1000), [pdf.resolve(x) for x in pdf.resolve(inner.get("W", []))]
            while rows:
                if isinstance(rows[1], list):
                    self.widths |= {rows[0] + i: w for i, w in enumerate(rows[1])}
                    rows = rows[2:]
                else:
                    self.widths |= dict.fromkeys(range(rows[0], rows[1] + 1), rows[2])
                    rows = rows[3:]
        elif "Widths" in about:
            self.widths = {about.get("FirstChar", 0) + i: pdf.resolve(w) for i, w in enumerate(pdf.resolve(about["Widths"]))}

    def read(self, codes: bytes) -> tuple[str, float, int, int]:
        """Text, width, how many codes and how many blanks. Short codes are kept, as words come again."""
        found = self.known.get(codes)
        if found is None:
            found = self._read(codes)
            if len(codes) <= 64:
                if len(self.known) >= 4096:
                    self.known.clear()
                self.known[codes] = found
        return found

    def words(self, codes: list[bytes]) -> tuple[list[str], list[int]] | None:
        """Texts and lengths of many strings in hexadecimal digits, read as one; none if they have to be looked at one by one."""
        sizes = list(map(len, codes))
        if not (self.wide and self.single and not self.widths and isinstance(self.default, int)) or any(n % 4 != 2 for n in set(sizes)):
            return None
        try:
            text = bytes.fromhex(b"".join(codes).replace(b"><", b"")[1:-1].decode()).decode("utf-16-be")
        except UnicodeDecodeError:
            return None
        sizes = [n >> 2 for n in sizes]
        ends = list(accumulate(sizes))
        if len(text) != ends[-1] or len(text := text.translate(self.table)) != ends[-1]:
            return None
        return [text[end - n : end] for end, n in zip(ends, sizes, strict=True)], sizes

    def _read(self, codes: bytes) -> tuple[str, float, int, int]:
        n = len(codes) // 2 if self.wide else len(codes)
        plain = not self.widths and isinstance(self.default, int)
        if self.wide and plain:
            try:
                text = codes[: 2 * n].decode("utf-16-be")
                if len(text) == n:  # codes in the range of surrogates are looked up one by one
                    return text.translate(self.table), n * self.default, n, 0
            except UnicodeDecodeError:
                pass
        numbers = struct.unpack_from(f">{n}H", codes) if self.wide else codes
        get = self.texts.get
        if self.wide:
            text = "".join([get(c) or "" for c in numbers])
        else:
            text = "".join([get(c) or bytes([c]).decode("cp1252", "replace") for c in numbers])
        return text, n * self.default if plain else sum(self.widths.get(c, self.default) for c in numbers), n, 0 if self.wide else codes.count(b" ")


def _unicode(cmap: bytes) -> dict[int, str]:
    out, stack, at = {}, [], 0
    # Blocks of pairs of four digits are read at once.
    while (begun := cmap.find(b"beginbfchar", at)) >= 0 and not re.search(rb"end|%|range", cmap[at:begun]):
        m = _CHARS.match(cmap, begun + 11)
        if not cmap.startswith(b"endbfchar", m.end()):
            break
        pairs = m[0].replace(b"<", b" ").replace(b">", b" ").split()
        text = bytes.fromhex(b"".join(pairs[1::2]).decode()).decode("utf-16-be", "surrogatepass")
        if len(text) != len(pairs) // 2 or not text.isascii() and any("\ud800" <= c <= "\udfff" for c in text):
            break
        out |= zip([int(x, 16) for x in pairs[::2]], text, strict=True)
        at = m.end() + 9
    for value, _ in values(cmap, at):
        if not isinstance(value, Operator):
            stack.append(value)
            continue
        if value == b"endbfchar":
            out |= {int.from_bytes(a, "big"): b.decode("utf-16-be", "replace") for a, b in zip(stack[::2], stack[1::2], strict=False)}
        elif value == b"endbfrange":
            for a, b, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                for i, n in enumerate(range(int.from_bytes(a, "big"), int.from_bytes(b, "big") + 1)):
                    out[n] = to[i].decode("utf-16-be", "replace") if isinstance(to, list) else (to[:-2] + (int.from_bytes(to[-2:], "big") + i).to_bytes(2, "big")).decode("utf-16-be", "replace")
        stack = []
    return out


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def items(pdf: Pdf, page: dict) -> Iterator[tuple[str, list[float], float, float]]:
    """str, transform, width, height of each piece of text that the page's operators show, in their order."""
    for texts, matrix, xs, ys, widths, height in pieces(pdf, page):
        for text, x, y, width in zip(texts, xs, ys, widths, strict=True):
            yield text, [*matrix, x, y], width, height


def pieces(pdf: Pdf, page: dict) -> Iterator[tuple]:
    """The page's items, those with one matrix and height that follow each other together: lists of str, x, y and width, beside the
    matrix's first four numbers and the height."""
    fonts = pdf.resolve((pdf.resolve(page.get("Resources")) or {}).get("Font")) or {}
    made: dict[str, Font] = {}
    state = {"ctm": ONE, "font": None, "size": 0.0, "chars": 0.0, "words": 0.0, "scale": 1.0, "leading": 0.0, "rise": 0.0}
    saved = []
    at = line = ONE

    def moved(matrix, x, y):
        return _times((1.0, 0.0, 0.0, 1.0, x, y), matrix)

    def font(name) -> Font:
        ref = fonts.get(name)
        number = ref.number if isinstance(ref, Ref) else None
        found = pdf.fonts.get(number) or Font(pdf, pdf.resolve(ref) or {})
        if number is not None:
            pdf.fonts[number] = found  # most pages of a file share its fonts
        return found

    def seen(matrix) -> tuple[list[float], float, float]:
        """Transform of an item that begins here, what its width is multiplied by, height."""
        a, b, c, d, e, f = matrix if state["ctm"] is ONE else _times(matrix, state["ctm"])
        size, rise = state["size"], state["rise"]
        wide, x, y = size * state["scale"], size * c, size * d
        return [wide * a, wide * b, x, y, rise * c + e, rise * d + f], abs(a), (x * x + y * y) ** 0.5

    def width(wide: float, n: int, blanks: int) -> float:
        return (wide / 1000 * state["size"] + n * state["chars"] + blanks * state["words"]) * state["scale"]

    def along(xs: list, ys: list, rows: list, steps: Sequence[float], a: float, b: float) -> tuple[list, list, float, float]:
        """Where each string of lines begins that begin at these places, and where the last ends."""
        across, down, begun = [], [], 0
        by = {gap: -float(gap) / 1000 * state["size"] * state["scale"] for gap in set().union(*(gaps for _, gaps in rows))}
        for e, f, (codes, gaps) in zip(xs, ys, rows, strict=True):
            moves = [0.0] * (2 * len(codes) - 1)
            moves[::2], moves[1::2] = steps[begun : begun + len(codes)], map(by.__getitem__, gaps)
            begun += len(codes)
            places = list(accumulate(moves if a == 1 else [m * a for m in moves], initial=e))
            across += places[:-1:2]
            e = places[-1]
            if b:
                places = list(accumulate([m * b for m in moves], initial=f))
                down += places[:-1:2]
                f = places[-1]
            else:
                down += [f] * len(codes)
        return across, down, e, f

    def read_all(used: Font, codes: list[bytes]) -> tuple[Sequence[str], Sequence[float]]:
        """Text and width of each string in hexadecimal digits."""
        if len(codes) > 1 and (read := used.words(codes)):
            for n in set(read[1]) - spans.keys():
                spans[n] = width(n * used.default, n, 0)
            return read[0], [spans[n] for n in read[1]]
        for code in codes:
            if code not in texts:
                own, *rest = used.read(_hex(code))
                texts[code] = own, width(*rest)
        return tuple(zip(*[texts[code] for code in codes], strict=True))

    texts: dict[bytes, tuple[str, float]] = {}  # text and width of codes while font, size and matrix stay as they are
    spans: dict[int, float] = {}  # and the width of so many codes where all have the same
    matrix = None
    for value, args in operations(pdf.content(page)):
        if value[:4] == b"Tm T":
            numbers, xs, ys, codes = args if len(value) > 5 else [args[0], *([x] for x in args[1:])]
            if numbers != matrix:
                if state["font"] not in made:
                    made[state["font"]] = font(state["font"])
                matrix, texts, spans = numbers, {}, {}
                a, b, c, d = map(float, numbers.split())
                (p, q, r, s, _, _), scale, height = seen((a, b, c, d, 0.0, 0.0))
            xs, ys = list(map(float, xs)), list(map(float, ys))
            if value == b"Tm TJ Tm TJ":
                found, steps = read_all(made[state["font"]], [code for row, _ in codes for code in row])
                line = (a, b, c, d, xs[-1], ys[-1])
                xs, ys, e, f = along(xs, ys, codes, steps, a, b)
                at = (a, b, c, d, e, f)
            else:
                found, steps = read_all(made[state["font"]], codes)
                at = line = (a, b, c, d, xs[-1], ys[-1])
                step = steps[-1]
                at = (a, b, c, d, step * a + at[4], step * b + at[5])
            if state["ctm"] is not ONE or state["rise"]:
                places = [seen((a, b, c, d, x, y))[0] for x, y in zip(xs, ys, strict=True)]
                xs, ys = [x[4] for x in places], [x[5] for x in places]
            if "" in found:
                kept = [i for i, text in enumerate(found) if text]
                found, steps, xs, ys = ([x[i] for i in kept] for x in (found, steps, xs, ys))
            if found:
                yield found, (p, q, r, s), xs, ys, [step * scale for step in steps], height
            continue
        shown, matrix = None, None
        match value:
            case b"Tm":
                at = line = tuple(map(float, args[-6:]))
            case b"Tj" | b"TJ":
                shown = args[-1] if value == b"TJ" else [args[-1]]
            case b"q":
                saved.append(dict(state))
            case b"Q" if saved:
                state = saved.pop()
            case b"cm":
                state["ctm"] = _times(tuple(args[-6:]), state["ctm"])
            case b"BT":
                at = line = ONE
            case b"Tf":
                state |= {"font": args[-2], "size": float(args[-1])}
            case b"Tc" | b"Tw" | b"TL" | b"Ts":
                state[{b"Tc": "chars", b"Tw": "words", b"TL": "leading", b"Ts": "rise"}[value]] = float(args[-1])
            case b"Tz":
                state["scale"] = args[-1] / 100
            case b"Td" | b"TD":
                at = line = moved(line, *args[-2:])
                if value == b"TD":
                    state["leading"] = -float(args[-1])
            case b"T*":
                at = line = moved(line, 0.0, -state["leading"])
            case b"'" | b'"':
                if value == b'"':
                    state |= {"words": float(args[-3]), "chars": float(args[-2])}
                at = line = moved(line, 0.0, -state["leading"])
                shown = [args[-1]]
        if shown is None:
            continue
        if state["font"] not in made:
            made[state["font"]] = font(state["font"])
        read, size = made[state["font"]].read, state["size"]
        text, total, begun = "", 0.0, at
        for piece in shown:
            if piece is None or isinstance(piece, int | float):
                if (piece is None or abs(piece) > FAR) and text:  # a wide gap parts items
                    transform, scale, height = seen(begun)
                    yield [text], transform[:4], [transform[4]], [transform[5]], [total * scale], height
                    text, total = "", 0.0
                if piece is None:
                    continue
                step = -piece / 1000 * size * state["scale"]
            else:
                own, wide, n, blanks = read(piece)
                text += own
                step = width(wide, n, blanks)
            a, b, c, d, e, f = at
            at = (a, b, c, d, step * a + e, step * b + f)
            if text:
                total += step
            else:
                begun = at
        if text:
            transform, scale, height = seen(begun)
            yield [text], transform[:4], [transform[4]], [transform[5]], [total * scale], height


def _walked(source, share: int, shares: int, take) -> Iterator[tuple]:
    """Number, what take(file, page's place) gives, and error of each page of a share; a file that cannot be read is page 0 of its first."""
    page = 0
    try:
        pdf = Pdf(source)
        for page in range(pdf.count * share // shares + 1, pdf.count * (share + 1) // shares + 1):
            try:
                found = take(pdf, page - 1)
            except Exception as e:  # noqa: BLE001  a broken page becomes a row
                yield page, None, f"{type(e).__name__}: {e}"
                continue
            yield page, found, None
    except Exception as e:  # noqa: BLE001  a broken file becomes a row, of its first share
        if share == 0:
            yield 0, None, f"{type(e).__name__}: {e}"


def rows_of(name: str, source, share: int = 0, shares: int = 1, contents: bool = True) -> Iterator[tuple]:
    """Rows of a file, or of one share of its pages; without contents one row a page, whose text is not looked at."""
    for page, found, error in _walked(source, share, shares, lambda pdf, i: list(items(pdf, pdf.page(i))) if contents else []):
        yield from [(name, page, i, *item, None) for i, item in enumerate(found)] if found else [(name, page, None, None, None, None, None, error)]


def _together(pdf: Pdf, i: int) -> tuple[list, ...]:
    """Texts, x, y, widths and heights of a page's items."""
    out: tuple[list, ...] = ([], [], [], [], [])
    for texts, _, xs, ys, widths, height in pieces(pdf, pdf.page(i)):
        for part, more in zip(out, (texts, xs, ys, widths, [height] * len(texts)), strict=True):
            part.extend(more)
    return out


def _page_batches(pages: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of PAGES from file, number, items and error of pages; a batch ends with the page that fills it."""

    def batch() -> pa.RecordBatch:
        offsets = pa.array([0, *accumulate(sizes)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(part, kind)) for part, kind in zip(parts, (pa.string(), *[pa.float64()] * 4), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int32()), *lists, pa.array(errors, pa.string())], names=["file", "page_number", "str", "x", "y", "width", "height", "error"])

    names, numbers, errors, sizes, parts = [], [], [], [], ([], [], [], [], [])
    for name, number, found, error in pages:
        names.append(name)
        numbers.append(number)
        errors.append(error)
        sizes.append(len(found[0]) if found else 0)
        for part, more in zip(parts, found or (), strict=False):
            part.extend(more)
        if len(parts[0]) + len(names) >= 4 * BATCH_ITEMS:
            yield batch()
            names, numbers, errors, sizes, parts = [], [], [], [], ([], [], [], [], [])
    if names:
        yield batch()


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) >= BATCH_ITEMS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _ARROW, strict=True)], schema=_ARROW)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _ARROW, strict=True)], schema=_ARROW)


def written(pages: list[list[str]]) -> bytes:
    """A file of these pages of lines: one font whose codes are the characters in order, all of one width."""
    signs = {c: i for i, c in enumerate(sorted(set().union(*(line for page in pages for line in page))), 1)}
    codes = {c: f"{i:04X}" for c, i in signs.items()} | {" ": f"> {-1000 * PITCH // TYPE} <"}

    def shown(page: list[str]) -> bytes:
        out = [f"1 0 0 1 {LEFT} {TOP - LEADING * n} Tm [<{''.join(map(codes.__getitem__, line))}>] TJ" for n, line in enumerate(page) if line.strip(" ")]
        return zlib.compress(f"BT /F1 {TYPE} Tf\n{chr(10).join(out)}\nET".encode(), 6)

    hundreds = [list(signs.items())[i : i + 100] for i in range(0, len(signs), 100)]
    cmap = "\n".join(f"{len(h)} beginbfchar\n" + "\n".join(f"<{i:04X}> <{c.encode('utf-16-be').hex()}>" for c, i in h) + "\nendbfchar" for h in hundreds).encode()
    bodies = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{6 + 2 * i} 0 R' for i in range(len(pages)))}] /Resources << /Font << /F1 3 0 R >> >> >>".encode(),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
        f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Plain /DW {1000 * PITCH // TYPE} >>".encode(),
        b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream",
    ]
    for i, page in enumerate(pages):
        content = shown(page)
        bodies += [f"<< /Type /Page /Parent 2 0 R /Contents {7 + 2 * i} 0 R >>".encode(), b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(content) + content + b"\nendstream"]
    out, offsets = bytearray(b"%PDF-1.7\n"), []
    for n, body in enumerate(bodies, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start))


class Shares(InputPartition):
    """Files of a partition: name, which share of its pages, of how many."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.contents = options.get("contents", "true").lower() == "true"

    def partitions(self) -> list[Shares]:
        from pyarrow import fs

        store, base = place(self.path)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if f.path.lower().endswith(".pdf"))
        out, small, size = [], [], 0
        for path, n in found:
            name, shares = path[len(base) :].lstrip("/"), -(-n // self.split)
            if shares > 1:
                out += [Shares([(name, k, shares)]) for k in range(shares)]
                continue
            if small and size + n > self.split:
                out.append(Shares(small))
                small, size = [], 0
            small.append((name, 0, 1))
            size += n
        return [*out, *([Shares(small)] if small else [])] or [Shares([])]

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        return _batches(row for name, source, share, shares in _opened(self.path, partition.files, self.contents) for row in rows_of(name, source, share, shares, self.contents))


def _opened(path: str, files: Iterable[tuple[str, int, int]], contents: bool = True) -> Iterator[tuple]:
    """Name, open file, share and shares, one file after the other."""
    store, base = place(path)
    for name, share, shares in files:
        with store.open_input_file(f"{base}/{name}") as file:
            # A small file is fetched in one read.
            yield name, io.BytesIO(file.read()) if shares == 1 and contents else file, share, shares


class PdfWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.folders = options["path"], int(options.get("folders", "1"))

    def write(self, iterator) -> WriterCommitMessage:
        store, base = place(self.path)
        store.create_dir(base, recursive=True)
        made = set()
        for name, pages in ((n.as_py(), p.as_py()) for batch in iterator for n, p in zip(batch["name"], batch["pages"], strict=True)):
            within = f"/{zlib.crc32(str(name).encode()) % self.folders:03x}" if self.folders > 1 else ""
            if within not in made:
                store.create_dir(base + within, recursive=True)
                made.add(within)
            with store.open_output_stream(f"{base}{within}/{name}.pdf") as out:
                out.write(written(pages))
        return WriterCommitMessage()


class PdfSource(DataSource):
    """spark.read.format("pdf").load(folder); df.write.format("pdf") for rows (name, pages array<array<string>>)."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options)

    def writer(self, schema, overwrite) -> PdfWriter:
        return PdfWriter(self.options)


def _dealt(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """file, share and shares of the files below a folder, listed and dealt out by tasks."""
    shares = F.greatest(F.ceil(F.col("size") / split_bytes), F.lit(1)).cast("int")
    files = pdfs(spark, path).select("file", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), shares.alias("shares"))
    return files.repartition(tasks(spark))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
    return (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, contents: bool = True) -> DataFrame:
    """Items of the files' pages; without contents one row a page, for which only the files' page trees are read. The rows of the data
    source, but tasks list the files: the driver's memory does not grow with their number."""

    def work(batches):
        yield from _batches(row for name, source, share, shares in _opened(path, _shares(batches), contents) for row in rows_of(name, source, share, shares, contents))

    return _dealt(spark, path, split_bytes).mapInArrow(work, SCHEMA)


def pages(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, use: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = PAGES) -> DataFrame:
    """The files' pages, one row each with its items' texts and numbers in arrays, in their order. use: what becomes of a batch of them, and
    the schema of that, in the task that reads them; items are many, and so they need not leave it."""

    def work(batches):
        found = _page_batches((name, *page) for name, source, share, shares in _opened(path, _shares(batches)) for page in _walked(source, share, shares, _together))
        yield from map(use, found) if use else found

    return _dealt(spark, path, split_bytes).mapInArrow(work, schema)


def write(rows: DataFrame, path: str, folders: int = 1) -> None:
    """rows: name, pages. With folders the files go into so many sub-folders by a hash of the name, so that tasks can list them."""
    rows.sparkSession.dataSource.register(PdfSource)
    rows.select("name", "pages").write.format("pdf").mode("append").option("path", path).option("folders", folders).save()


def read_contents(files: DataFrame) -> DataFrame:
    """The same rows from files whose bytes a table or stream holds: path, content."""

    def work(batches):
        for batch in batches:
            yield from _batches(row for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in rows_of(path, io.BytesIO(content or b"")))

    return files.select("path", "content").mapInArrow(work, SCHEMA)


def arriving(spark: SparkSession, path: str, files_a_batch: int = 1_000) -> DataFrame:
    """A stream of the rows of files that come into a folder; each file is read once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_a_batch)
    return read_contents(files.load(path))
