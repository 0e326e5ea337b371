"""Pages of PDF files: text layer, size, boxes of embedded images. The default reader is plain Python and covers uncompressed and deflated
content, compressed objects, simple fonts in the usual Western encoding and all fonts with a table of their characters (ToUnicode); pdfplumber is used instead
where it is installed."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, page_index int, text string, width double, height double, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>, error string"

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFS = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+")
#: Thousandths of the letter size that part two words within one array of strings.
GAP = 180
_ESCAPES = {b"n": "\n", b"r": "\r", b"t": "\t", b"b": "\b", b"f": "\f"}


@dataclass
class Page:
    text: str = ""
    width: float = 612.0
    height: float = 792.0
    boxes: list[tuple[float, float, float, float]] = field(default_factory=list)


def _bytes(raw: bytes) -> bytes:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1]).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2))

    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r") else _ESCAPES.get(x, x.decode("latin-1")).encode("latin-1")

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw[1:-1], flags=re.S)


class Font:
    """The characters of a font's codes; without a table, codes are bytes of the usual Western encoding."""

    def __init__(self, table: bytes = b""):
        hexes = lambda x: [bytes.fromhex(re.sub(rb"\s", b"", h).decode()) for h in re.findall(rb"<([0-9A-Fa-f\s]*)>", x)]
        text = lambda x: x.decode("utf-16-be", "replace")
        space = re.search(rb"begincodespacerange(.*?)endcodespacerange", table, re.S)
        codes = hexes(space[1]) if space else []
        self.width, self.chars = (len(codes[0]) if codes else 1) or 1, {}
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
            pairs = hexes(part)
            self.chars.update((int.from_bytes(c, "big"), text(t)) for c, t in zip(pairs[::2], pairs[1::2]))
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
            for m in re.finditer(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>\s*(\[.*?\]|<[0-9A-Fa-f\s]*>)", part, re.S):
                lo, hi = (int(re.sub(rb"\s", b"", x), 16) for x in (m[1], m[2]))
                to = hexes(m[3])
                for i in range(min(hi - lo + 1, 1 << 16)):
                    if m[3][:1] == b"[":
                        if i < len(to):
                            self.chars[lo + i] = text(to[i])
                    elif to and to[0]:
                        self.chars[lo + i] = text(to[0][:-2] + ((int.from_bytes(to[0][-2:], "big") + i) & 0xFFFF).to_bytes(min(2, len(to[0])), "big"))

    def read(self, raw: bytes) -> str:
        if not self.chars:
            return raw.decode("cp1252", "replace") if self.width == 1 else ""
        return "".join(self.chars.get(int.from_bytes(raw[i : i + self.width], "big"), "") for i in range(0, len(raw), self.width))


_PLAIN = Font()


def _multiply(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _run(content: bytes, images: set[bytes], page: Page, fonts: dict[bytes, Font]) -> None:
    """Walk the content stream: text operators give lines, image operators give boxes. In an array of strings a wide gap stands for a blank."""
    lines, line, stack, args, matrix, font = [], "", [], [], (1, 0, 0, 1, 0, 0), _PLAIN
    num = lambda k: [float(x) for x in args[-k:]]
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            args.append(t)
            continue
        if t in (b"Tj", b"'", b'"') and args:
            if t != b"Tj" and line:
                lines.append(line)
                line = ""
            line += font.read(_bytes(args[-1]))
        elif t == b"TJ":
            for x in args:
                if x[:1] in b"(<":
                    line += font.read(_bytes(x))
                elif x[:1] not in b"[]/" and float(x) < -GAP and line and not line[-1].isspace():
                    line += " "
        elif t == b"Tf" and len(args) >= 2:
            font = fonts.get(args[-2][1:], _PLAIN)
        elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET") and line and (t != b"Td" or float(args[-1]) != 0):
            lines.append(line)
            line = ""
        elif t == b"q":
            stack.append(matrix)
        elif t == b"Q" and stack:
            matrix = stack.pop()
        elif t == b"cm" and len(args) >= 6:
            matrix = _multiply(tuple(num(6)), matrix)
        elif t == b"Do" and args and args[-1][1:] in images:
            xs = sorted((matrix[4], matrix[4] + matrix[0] + matrix[2]))
            ys = sorted((matrix[5], matrix[5] + matrix[1] + matrix[3]))
            page.boxes.append((xs[0], ys[0], xs[1], ys[1]))
        args = []
    page.text = "\n".join([*lines, *([line] if line else [])]).strip()


def parse(data: bytes) -> list[Page]:
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for raw in [x for x in objects.values() if re.search(rb"/Type\s*/ObjStm\b", x)]:  # objects kept together in one compressed stream
        m, count, first = _STREAM.search(raw), re.search(rb"/N\s+(\d+)", raw), re.search(rb"/First\s+(\d+)", raw)
        if m and count and first:
            body = zlib.decompress(m[1]) if b"/FlateDecode" in raw[: m.start()] else m[1]
            head = list(map(int, body[: int(first[1])].split()[: 2 * int(count[1])]))
            ends = [*head[3::2], len(body) - int(first[1])]
            for n, lo, hi in zip(head[::2], head[1::2], ends):
                objects.setdefault(n, body[int(first[1]) + lo : int(first[1]) + hi])

    def follow(raw: bytes, key: bytes) -> bytes:
        m = re.search(rb"/" + key + rb"\s*(\d+)\s+\d+\s+R", raw)
        if m:
            return objects.get(int(m[1]), b"")
        m = re.search(rb"/" + key + rb"\s*(<<.*?>>|\[.*?\])", raw, re.S)
        return m[1] if m else b""

    def stream(raw: bytes) -> bytes:
        m = _STREAM.search(raw)
        return b"" if not m else zlib.decompress(m[1]) if b"/FlateDecode" in raw[: m.start()] else m[1]

    kids: list[int] = []
    above: dict[int, bytes] = {}

    def walk(n: int, depth: int = 0, inherited: bytes = b"") -> None:
        raw = objects.get(n, b"")
        if re.search(rb"/Type\s*/Pages\b", raw) and depth < 50:
            for k in _REFS.findall(follow(raw, b"Kids") or b""):
                walk(int(k), depth + 1, raw + inherited)
        elif re.search(rb"/Type\s*/Page\b", raw):
            kids.append(n)
            above[n] = inherited

    for n, raw in objects.items():
        if re.search(rb"/Type\s*/Catalog\b", raw):
            root = re.search(rb"/Pages\s*(\d+)", raw)
            if root:
                walk(int(root[1]))
    out = []
    for n in kids or [n for n, raw in objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", raw)]:
        raw, page = objects[n], Page()
        box = next((m for x in (raw, above.get(n, b""), data) if (m := re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", x))), None)
        if box:
            x0, y0, x1, y1 = map(float, box.groups())
            page.width, page.height = x1 - x0, y1 - y0
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", raw)
        content = b"\n".join(stream(objects.get(int(k), b"")) for k in _REFS.findall(m[1])) if m else b""
        outer = above.get(n, b"")
        resources = raw + follow(raw, b"Resources") if b"/Resources" in raw else raw + outer + follow(outer, b"Resources")
        resources += follow(resources, b"XObject") + follow(resources, b"Font")
        named = {name: int(k) for name, k in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", resources)}
        images = {name for name, k in named.items() if re.search(rb"/Subtype\s*/Image\b", objects.get(k, b""))}
        fonts = {name: Font(stream(follow(objects.get(k, b""), b"ToUnicode"))) for name, k in named.items() if b"/ToUnicode" in objects.get(k, b"")}
        fonts |= {name: Font(b"begincodespacerange <0000> endcodespacerange") for name, k in named.items() if name not in fonts and re.search(rb"/Subtype\s*/Type0\b", objects.get(k, b""))}
        _run(content, images, page, fonts)
        out.append(page)
    return out


def _plumbed(data: bytes) -> list[Page] | None:
    try:
        import io

        import pdfplumber
    except ImportError:
        return None
    with pdfplumber.open(io.BytesIO(data)) as f:
        return [Page((p.extract_text() or "").strip(), float(p.width), float(p.height), [(i["x0"], float(p.height) - i["bottom"], i["x1"], float(p.height) - i["top"]) for i in p.images]) for p in f.pages]


def read(data: bytes) -> list[Page]:
    pages = _plumbed(data)
    return parse(data) if pages is None else pages


def _rows(path: str, data: bytes) -> Iterator[tuple]:
    try:
        for i, p in enumerate(read(data)):
            yield path, i, p.text, p.width, p.height, [dict(zip(("x0", "y0", "x1", "y1"), b)) for b in p.boxes], None
    except Exception as e:  # a broken file is a row with its error, not a failed job
        yield path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]


def pages(files: DataFrame) -> DataFrame:
    """From files (path, content): one row a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = pa.list_(pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")]))
        kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), box, pa.string()]
        names = ["path", "page_index", "text", "width", "height", "boxes", "error"]
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(_rows(path, data or b""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.select("path", F.col("content")).mapInArrow(run, SCHEMA)


class PdfPages(DataSource):
    """spark.dataSource.register(PdfPages); spark.read.format("pdfpages").load(folder or file): one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "pdfpages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "**", "*.pdf"), recursive=True)) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from _rows(partition.value, f.read())
