"""From files to page rows: text layer where there is one, else recognition, else vision; figures read on their own; repeated lines listed once.
Files already in the cache (same content and options) are not read again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlake.backends import Backends
from ctxlake.config import DEFAULT, EngineConfig
from ctxlake.functions.images import prepared
from ctxlake.operators import boilerplate, pages, store
from ctxlake.sources import images, pdf

PAGE_PROMPT = "Transcribe all text of this page."
FIGURE_PROMPT = "Describe this figure and transcribe its text."
ROW = "content_hash string, path string, source_type string, page_index int, method string, text string, ocr_confidence double, ocr_word_count int, raw_tokens_est int, distilled_tokens_est int, warnings array<string>, image_count int, figures array<string>, error string"
_ARROW = pa.schema(
    [("content_hash", pa.string()), ("path", pa.string()), ("source_type", pa.string()), ("page_index", pa.int32()), ("method", pa.string()), ("text", pa.string()), ("ocr_confidence", pa.float64()), ("ocr_word_count", pa.int32()), ("raw_tokens_est", pa.int32()), ("distilled_tokens_est", pa.int32()), ("warnings", pa.list_(pa.string())), ("image_count", pa.int32()), ("figures", pa.list_(pa.string())), ("error", pa.string())]
)


def text_cost(text: str) -> int:
    return max(1, round(len(text) / 4.0)) if text else 0


def image_cost(w: float, h: float, cfg: EngineConfig) -> int:
    if w <= 0 or h <= 0:
        return 0
    scale = min(1.0, cfg.image_max_edge / max(w, h))
    w, h = (max(1, round(x * scale)) if scale < 1 else x for x in (w, h))
    return max(1, round(w * h / cfg.image_divisor))


def crop_box(box: tuple[float, float, float, float], page_height: float, size: tuple[int, int], dpi: float) -> tuple[int, int, int, int]:
    """Left, top, right, bottom in pixels, by the rules of functions.tokens.crop: flipped, scaled, held within the page; a box without area stands for the page."""
    x0, y0, x1, y1 = (v * dpi / 72.0 for v in (box[0], page_height - box[3], box[2], page_height - box[1]))
    hold = lambda v, most: min(max(int(v), 0), most)
    left, top, right, bottom = hold(x0, size[0]), hold(y0, size[1]), hold(x1, size[0]), hold(y1, size[1])
    return (left, top, right, bottom) if right > left and bottom > top else (0, 0, *size)


def recognise(image: bytes, b: Backends, cfg: EngineConfig, vision: bool, prompt: str) -> tuple[str, str, float, int, list[str]]:
    """method, text, confidence, words, warnings."""
    text, conf, words = b.ocr(image) if b.ocr else ("", 0.0, 0)
    if (b.ocr_retry or b.ocr) and not (conf >= cfg.retry_confidence and words >= cfg.retry_min_words):
        try:  # without a second service, the first gets the prepared image
            again = b.ocr_retry(image) if b.ocr_retry else b.ocr(images.png(prepared(images.load(image))))
            if (again[2], again[1]) > (words, conf):
                text, conf, words = again
        except Exception:  # the first pass stands
            pass
    if not vision or (conf >= cfg.ocr_confidence and words >= cfg.ocr_min_words):
        return "ocr", text, conf, words, []
    seen = b.vision(image, prompt) if b.vision else None
    if seen is not None:
        return "vision", seen, conf, words, []
    return "ocr_degraded", text, conf, words, ["low confidence and no vision service"]


def _one(path: str, data: bytes, b: Backends, cfg: EngineConfig, vision: bool, figures: bool) -> Iterator[dict]:
    if path.lower().endswith(cfg.pdf_suffixes):
        for i, p in enumerate(pdf.read(data)):
            boxes = [x for x in p.boxes if x[2] - x[0] >= cfg.figure_min_side and x[3] - x[1] >= cfg.figure_min_side]
            if len(p.text) >= cfg.min_native_chars:
                read, notes = _figures(data, i, p, boxes, b, cfg, vision) if figures and boxes and b.rasterise and b.crop else ([], [])
                px = [max(1, round(x * cfg.render_dpi / 72.0)) for x in (p.width, p.height)]
                yield {"page_index": i, "method": "native_text", "text": p.text, "raw_tokens_est": image_cost(*px, cfg) + text_cost(p.text), "distilled_tokens_est": text_cost(p.text) + sum(map(text_cost, read)), "warnings": notes, "image_count": len(boxes), "figures": read}
            elif b.rasterise:
                yield {"page_index": i, **_image(b.rasterise(data, i, 200), b, cfg, vision)}
            else:
                yield {"page_index": i, "method": "ocr_degraded", "text": p.text, "raw_tokens_est": 0, "distilled_tokens_est": text_cost(p.text), "warnings": ["no rasteriser"], "image_count": len(boxes), "figures": []}
    else:
        yield {"page_index": 0, **_image(data, b, cfg, vision)}


def _image(image: bytes, b: Backends, cfg: EngineConfig, vision: bool) -> dict:
    method, text, conf, words, notes = recognise(image, b, cfg, vision, PAGE_PROMPT)
    try:
        w, h = b.measure(image) if b.measure else images.size(image)
    except Exception:
        w, h = 0, 0
    return {"method": method, "text": text, "ocr_confidence": conf, "ocr_word_count": words, "raw_tokens_est": image_cost(w, h, cfg), "distilled_tokens_est": text_cost(text), "warnings": notes, "image_count": 0, "figures": []}


def _figures(data: bytes, i: int, p: pdf.Page, boxes: list, b: Backends, cfg: EngineConfig, vision: bool) -> tuple[list[str], list[str]]:
    """Texts of the figures that could be read; the page is rendered once for all of them."""
    try:
        image = b.rasterise(data, i, 200)
    except Exception as e:
        return [], [f"figures: {e}"]
    out, notes = [], []
    size = (max(1, round(p.width * 200 / 72.0)), max(1, round(p.height * 200 / 72.0))) if not b.measure else b.measure(image)
    for box in boxes:
        try:
            part = b.crop(image, crop_box(box, p.height, size, 200))
            text = recognise(part, b, cfg, vision, FIGURE_PROMPT)[1].strip()
            out += [text] if text else []
        except Exception as e:
            notes.append(f"figure: {e}")
    return out, notes


def read_pages(files: DataFrame, backends: Backends, cfg: EngineConfig = DEFAULT, vision: bool = True, figures: bool = True) -> DataFrame:
    """From files (content_hash, path, content): page rows; a file that cannot be read is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, path, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                kind = "pdf" if path.lower().endswith(cfg.pdf_suffixes) else "image"
                try:
                    if not path.lower().endswith(cfg.distillable):
                        raise ValueError("unsupported suffix")
                    rows = list(_one(path, data, backends, cfg, vision, figures))
                except Exception as e:
                    rows = [{"error": f"{type(e).__name__}: {e}"[:500]}]
                rows = [{"content_hash": key, "path": path, "source_type": kind, **r} for r in rows]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("content_hash", "path", "content").mapInArrow(run, ROW)


def distill(files: DataFrame, cache: DataFrame, backends: Backends, cfg: EngineConfig = DEFAULT, vision: bool = True, figures: bool = True, dedupe: bool = True) -> DataFrame:
    """Page rows of all files: cached ones from ``cache`` (page rows with options), the others read, with repeated lines stripped unless ``dedupe`` is off (a document of
    one page has none). The cache key is content and options, so a result without figures never stands in for one with them."""
    options = f"vision={vision},figures={figures}"
    known = cache.where(F.col("options") == options)
    fresh = read_pages(store.misses(files.dropDuplicates(["content_hash"]), known), backends, cfg, vision, figures)
    if dedupe:
        fresh = pages.recount(boilerplate.strip_pages(fresh.withColumnRenamed("content_hash", "doc_key"), cfg)).withColumnRenamed("doc_key", "content_hash")
    fresh = fresh.withColumn("options", F.lit(options)).withColumn("cached", F.lit(False))
    again = known.drop("path").join(files.select("content_hash", "path"), "content_hash").withColumn("cached", F.lit(True))
    return fresh.unionByName(again, allowMissingColumns=True)


def results(distilled: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """A row a file: content_hash, path, source_type, error, and, of those that were read, the columns of pages.documents() with rendered_text."""
    ok = distilled.where("error IS NULL").withColumnRenamed("content_hash", "doc_key")
    once = ok.dropDuplicates(["doc_key", "page_index"])
    docs = boilerplate.rendered(pages.documents(once), boilerplate.manifest(once, cfg), cfg)
    names = distilled.select("content_hash", "path", "source_type", "error").distinct()
    return names.join(docs.withColumnRenamed("doc_key", "content_hash"), "content_hash", "left")


def packed_files(distilled: DataFrame) -> DataFrame:
    """path, text, tokens, error: what pack() takes for the distillable files of a tree."""
    return results(distilled).select("path", F.col("rendered_text").alias("text"), F.col("distilled_tokens").alias("tokens"), "error")


def scan_totals(distilled: DataFrame) -> DataFrame:
    """One row: files read, files failed, raw and distilled tokens."""
    per = distilled.groupBy("content_hash").agg(F.max(F.col("error").isNotNull()).alias("bad"), F.sum(F.coalesce("raw_tokens_est", F.lit(0))).alias("raw"), F.sum(F.coalesce("distilled_tokens_est", F.lit(0))).alias("out"))
    return per.agg(F.count_if(~F.col("bad")).alias("ok"), F.count_if("bad").alias("failed"), F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_tokens"), F.coalesce(F.sum("out"), F.lit(0)).alias("distilled_tokens"))


