"""Files, services and event lines made of the test tables, for the queries over sources and distilling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlake.backends import Backends
from ctxlake.functions.text import let
from ctxlake.runtime import spread, table

#: Letters of a line and of a page of a made PDF file.
LINE, PAGE = 100, 300


def _pdf(text: Column, doc_id: Column) -> Column:
    """A PDF file of plain objects: a page for each PAGE letters in lines of LINE, every third page with an image of 80 x 80 points."""
    pages = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / PAGE).cast("int") - 1, F.lit(0))), lambda i: F.struct(i.alias("i"), F.substring(text, i * PAGE + 1, F.lit(PAGE)).alias("t")))
    number = lambda n: n.cast("string")

    def one(p: Column) -> Column:
        lines = F.filter(F.transform(F.sequence(F.lit(0), F.lit(PAGE // LINE - 1)), lambda k: F.substring(p["t"], k * LINE + 1, F.lit(LINE))), lambda x: x != "")
        body = F.concat(F.lit("BT /F1 12 Tf 72 720 Td "), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("("), x, F.lit(") Tj"))), " 0 -14 Td "), F.lit(" ET"), F.when((doc_id + p["i"]) % 3 == 0, " q 80 0 0 80 300 100 cm /Im1 Do Q").otherwise(""))
        page, content = 10 + 2 * p["i"], 11 + 2 * p["i"]
        return F.concat(
            number(page), F.lit(" 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents "), number(content), F.lit(" 0 R /Resources << /XObject << /Im1 3 0 R >> >> >>\nendobj\n"),
            number(content), F.lit(" 0 obj\n<< /Length "), number(F.length(body)), F.lit(" >>\nstream\n"), body, F.lit("\nendstream\nendobj\n"),
        )

    def file(ps: Column) -> Column:
        kids = F.array_join(F.transform(ps, lambda p: F.concat(number(10 + 2 * p["i"]), F.lit(" 0 R"))), " ")
        return F.concat(
            F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids ["), kids, F.lit("] /Count "), number(F.size(ps)), F.lit(" >>\nendobj\n3 0 obj\n<< /Type /XObject /Subtype /Image /Width 4 /Height 4 >>\nstream\nxxxx\nendstream\nendobj\n"),
            F.array_join(F.transform(ps, one), ""), F.lit("%%EOF"),
        )

    return let(pages, file)


def files(s: SparkSession, d: str) -> DataFrame:
    """content_hash, path, content: each document as a file, most of them PDF files, some images, some broken, some of another kind."""
    kind = F.col("doc_id") % 10
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9.,]+", " "))
    rows = spread(table(s, d, "documents")).select("doc_id", plain.alias("t"))
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.when(kind == 0, ".PNG").when(kind == 2, ".gif").otherwise(".pdf"))
    content = F.when(kind == 0, F.concat(F.lit("image of "), F.col("t"))).when(kind == 1, "no file of this kind").otherwise(_pdf(F.col("t"), F.col("doc_id")))
    return rows.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("content_hash"), path.alias("path"), F.encode(content, "UTF-8").alias("content"))


def pixmaps(s: SparkSession, d: str) -> DataFrame:
    """path, content: a small image for each part, the left half dark and the right half light; every ninth one is cut off."""
    p = table(s, d, "part")
    w, h = F.col("p_size") % 6 + 1, (F.col("p_partkey") % 5 + 1).cast("int")
    row = F.concat(F.repeat(F.lit("!"), 3 * w), F.repeat(F.lit("z"), 3 * w))
    image = F.concat(F.lit("P6\n"), (2 * w).cast("string"), F.lit(" "), h.cast("string"), F.lit("\n255\n"), F.when(F.col("p_partkey") % 9 > 0, F.repeat(row, h)).otherwise(""))
    return p.select(F.concat(F.lit("/im/"), F.col("p_partkey").cast("string"), F.lit(".ppm")).alias("path"), F.encode(image, "UTF-8").alias("content"))


def _ocr(image: bytes) -> tuple[str, float, int]:
    """Weak on whole pages, good on figures and images."""
    return (image.decode(), 40.0, 2) if image.startswith(b"page") else (image.decode()[:40].strip(), 95.0, 9)


#: Services that answer from the bytes they get. Every second page is one that vision does not answer for.
STAND_INS = Backends(
    ocr=_ocr,
    ocr_retry=lambda image: (image.decode() + " again", 60.0, 3),
    rasterise=lambda data, i, dpi: b"page %d" % i,
    crop=lambda image, box: ("figure %d %d %d %d" % box).encode(),
    measure=lambda image: (1700, 2200),
    vision=lambda image, prompt: "seen " + image.decode() if image[-1:] in b"02468" else None,
)


def event_lines(s: SparkSession, d: str, log: DataFrame | None = None) -> DataFrame:
    """value: tool calls as JSON lines, every tenth of them broken."""
    log = table(s, d, "activity_log") if log is None else log
    call = F.struct("session_id", "tool_name", F.struct(F.concat(F.lit("/f/"), F.col("seq").cast("string"), F.lit(".md")).alias("file_path"), F.when(F.col("seq") % 3 == 0, (F.col("seq") % 50).cast("int")).alias("offset"), F.when(F.col("tool_name") == "Bash", "pytest -q").alias("command")).alias("tool_input"))
    return log.select(F.when(F.col("seq") % 10 == 0, "{broken").otherwise(F.to_json(call)).alias("value"))
