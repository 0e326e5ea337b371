"""Images as pixels. PNG files of 8 bits a channel (not interlaced) and portable pixmaps are read here; every other format where Pillow is installed."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ctxlake.config import DEFAULT, EngineConfig

SCHEMA = "path string, width int, height int, rgb binary, error string"
#: Channels of a PNG colour type (fixed values).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfiltered(raw: bytes, width: int, height: int, n: int) -> np.ndarray:
    """Undo the row filters: none, left, up, mean of both, nearest of three."""
    rows = np.frombuffer(raw, np.uint8)[: height * (1 + width * n)].reshape(height, 1 + width * n)
    above, out = np.zeros(width * n, np.uint8), np.empty((height, width * n), np.uint8)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            line = line.copy()
        elif kind == 1:
            line = np.cumsum(line.reshape(width, n), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            now, up, raw_ = [0] * (width * n), above.tolist(), line.tolist()
            for i, v in enumerate(raw_):
                a, b = (now[i - n] if i >= n else 0), up[i]
                if kind == 3:
                    p = (a + b) >> 1
                else:
                    c = up[i - n] if i >= n else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if da <= db and da <= dc else b if db <= dc else c
                now[i] = (v + p) & 255
            line = np.array(now, np.uint8)
        else:
            raise ValueError(f"unknown row filter {kind}")
        out[y] = above = line
    return out.reshape(height, width, n)


def _png(data: bytes) -> np.ndarray:
    parts: dict[bytes, bytes] = {}
    for kind, body in _chunks(data):
        parts[kind] = parts.get(kind, b"") + body
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if depth != 8 or interlaced or colour not in CHANNELS:
        raise NotImplementedError("another kind of PNG")
    x = _unfiltered(zlib.decompress(parts[b"IDAT"]), width, height, CHANNELS[colour])
    if colour == 3:
        return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[x[:, :, 0]]
    return x[:, :, :3] if colour in (2, 6) else np.repeat(x[:, :, :1], 3, 2)


def _pixmap(data: bytes) -> np.ndarray:
    head, at = [], 2
    while len(head) < 3:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        head.append(int(data[at:end]))
        at = end
    width, height, most = head
    if most != 255:
        raise NotImplementedError("more than 8 bits")
    n = 3 if data[:2] == b"P6" else 1
    x = np.frombuffer(data, np.uint8, width * height * n, at + 1).reshape(height, width, n)
    return np.repeat(x, 3, 2) if n == 1 else x


def load(data: bytes) -> np.ndarray:
    """[height, width, 3] of an image file."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] in (b"P5", b"P6"):
            return _pixmap(data)
    except NotImplementedError:
        pass
    try:
        import io

        from PIL import Image
    except ImportError:
        raise ValueError("no reader for this kind of image") from None
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def png(x: np.ndarray) -> bytes:
    """A PNG file of [height, width] or [height, width, 3]."""
    x = x if x.ndim == 3 else x[:, :, None]
    h, w, n = x.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(x, np.uint8).reshape(h, w * n)], 1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def size(data: bytes) -> tuple[int, int]:
    """Width and height."""
    x = load(data)
    return x.shape[1], x.shape[0]


def images(files: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """path, width, height, rgb (three bytes a pixel), error, of files (path, content): one that cannot be read is a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = {"path": path, "width": None, "height": None, "rgb": None, "error": None}
                try:
                    x = load(data or b"")
                    row |= {"width": x.shape[1], "height": x.shape[0], "rgb": np.ascontiguousarray(x).tobytes()}
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in (("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary()), ("error", pa.string()))], names=["path", "width", "height", "rgb", "error"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)
