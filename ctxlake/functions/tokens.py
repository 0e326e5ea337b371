"""Token cost of images and rendered PDF pages, and the geometry of figure crops (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxlake.config import DEFAULT, EngineConfig
from ctxlake.functions.text import text_tokens


def downscaled(w: Column, h: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """STRUCT<w, h>: scaled so that the longer edge fits the cap; neither side below 1."""
    w, h = w.cast("double"), h.cast("double")
    longest = F.greatest(w, h)
    scale = F.lit(cfg.image_max_edge) / longest
    side = lambda x: F.when(longest <= cfg.image_max_edge, x).otherwise(F.greatest(F.lit(1.0), F.bround(x * scale))).cast("long")
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def image_tokens(w: Column, h: Column, cfg: EngineConfig = DEFAULT) -> Column:
    d = downscaled(w, h, cfg)
    return F.when((w <= 0) | (h <= 0), F.lit(0)).otherwise(F.greatest(F.lit(1.0), F.bround(d["w"] * d["h"] / F.lit(cfg.image_divisor)))).cast("long")


def page_host_tokens(width_pt: Column, height_pt: Column, text: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """What a host pays for a PDF page: its rendering as an image, and its text."""
    px = lambda pt: F.greatest(F.lit(1.0), F.bround(pt.cast("double") * F.lit(cfg.render_dpi) / F.lit(72.0)))
    return image_tokens(px(width_pt), px(height_pt), cfg) + text_tokens(text)


def large_enough(boxes: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Figure boxes (x0, y0, x1, y1 in points) with both sides of at least the minimum."""
    return F.filter(boxes, lambda b: (b["x1"] - b["x0"] >= cfg.figure_min_side) & (b["y1"] - b["y0"] >= cfg.figure_min_side))


def crop(box: Column, page_height_pt: Column, width_px: Column, height_px: Column, dpi: float) -> Column:
    """STRUCT<left, top, right, bottom> in pixels of a box with its origin at the bottom left: flipped, scaled, truncated, held within
    the page; a box without area stands for the whole page."""
    s = F.lit(dpi / 72.0)
    hold = lambda v, most: F.least(F.greatest(v.cast("long"), F.lit(0)), most.cast("long"))
    left, right = hold(box["x0"] * s, width_px), hold(box["x1"] * s, width_px)
    top, bottom = hold((page_height_pt - box["y1"]) * s, height_px), hold((page_height_pt - box["y0"]) * s, height_px)
    flat = (right <= left) | (bottom <= top)
    whole = lambda v, w: F.when(flat, w.cast("long")).otherwise(v)
    return F.struct(whole(left, F.lit(0)).alias("left"), whole(top, F.lit(0)).alias("top"), whole(right, width_px).alias("right"), whole(bottom, height_px).alias("bottom"))


def dot(a: Column, b: Column) -> Column:
    """Sum of the products over the common length."""
    n = F.greatest(F.least(F.size(a), F.size(b)), F.lit(0))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, e: s + e)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine over the common length; 0 where a vector is null, empty or all zero. The norms may be at hand."""
    both = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(F.coalesce(both, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(dot(a, b) / both)
