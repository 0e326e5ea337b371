"""Preparing an image for recognition, on arrays of pixels: grey, full contrast, enlarged if small, black and white."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Images with a side under this many pixels are enlarged by this factor.
SMALL, FACTOR = 600, 2


def grey(rgb: np.ndarray) -> np.ndarray:
    """[height, width, 3] to [height, width] by the usual weights of the colours (of 1,000: 299, 587, 114)."""
    return ((rgb.astype(np.uint32) @ np.array([19595, 38470, 7471], np.uint32) + 0x8000) >> 16).astype(np.uint8)


def full_contrast(g: np.ndarray) -> np.ndarray:
    """The darkest level to 0 and the lightest to 255; unchanged where there is one level only."""
    lo, hi = int(g.min()), int(g.max())
    return g if hi <= lo else np.clip((g.astype(np.float64) - lo) * 255.0 / (hi - lo), 0, 255).astype(np.uint8)


def _weights(n: int, factor: int, reach: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For each new pixel the old ones within reach, and a windowed sinc of their distances."""
    at = (np.arange(n * factor) + 0.5) / factor - 0.5
    old = np.floor(at).astype(int)[:, None] + np.arange(1 - reach, reach + 1)
    x = at[:, None] - old
    w = np.where((np.abs(x) < reach) & (old >= 0) & (old < n), np.sinc(x) * np.sinc(x / reach), 0.0)
    return np.clip(old, 0, n - 1), w / w.sum(1, keepdims=True)


def enlarged(g: np.ndarray, factor: int = FACTOR) -> np.ndarray:
    for axis in (0, 1):
        old, w = _weights(g.shape[axis], factor)
        rows = np.moveaxis(g.astype(np.float64), axis, 0)
        g = np.moveaxis(np.clip(np.rint(np.einsum("ik,ik...->i...", w, rows[old])), 0, 255), 0, axis)
    return g.astype(np.uint8)


def threshold(histogram: np.ndarray) -> int:
    """Midpoint of the plateau of greatest between-class variance; 128 where one level holds everything (as operators.pages.otsu)."""
    n = np.asarray(histogram, np.float64)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1 = n.sum() - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2, 0.0)
    best = np.flatnonzero(v == v.max()) if v.max() > 0 else []
    return int(best[0] + best[-1]) // 2 if len(best) else 128


def prepared(rgb: np.ndarray, small: int = SMALL, factor: int = FACTOR) -> np.ndarray:
    """0 and 255 only."""
    g = full_contrast(grey(rgb))
    if min(g.shape) < small:
        g = enlarged(g, factor)
    return np.where(g > threshold(np.bincount(g.ravel(), minlength=256)), 255, 0).astype(np.uint8)


def prepare(images: DataFrame, id_col: str = "id", small: int = SMALL, factor: int = FACTOR) -> DataFrame:
    """id, width, height, pixels (a byte each), error of images (id, width, height, rgb: three bytes a pixel, row by row). An image whose bytes do not fit its size is
    a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, h, raw in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                try:
                    p = prepared(np.frombuffer(raw, np.uint8).reshape(h, w, 3), small, factor)
                    out.append((p.shape[1], p.shape[0], p.tobytes(), None))
                except Exception as e:
                    out.append((None, None, None, f"{type(e).__name__}: {e}"[:200]))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.string())))], names=[id_col, "width", "height", "pixels", "error"])

    part = images.select(id_col, "width", "height", "rgb")
    return part.mapInArrow(run, part.select(id_col).schema.add("width", T.IntegerType()).add("height", T.IntegerType()).add("pixels", T.BinaryType()).add("error", T.StringType()))
