"""External services as plain functions that run in the Python workers: text recognition, rasterising, vision, embedding, exact token counts. Each
may be absent (None); what depends on it then takes its degraded branch. A service that fails gives an error text, never a failed job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

OcrResult = tuple[str, float, int]


@dataclass(frozen=True)
class Backends:
    #: image bytes -> text, mean confidence, number of words
    ocr: Callable[[bytes], OcrResult] | None = None
    #: the same for a second pass, asked for when the first is weak; without it the first service gets the image in black and white
    ocr_retry: Callable[[bytes], OcrResult] | None = None
    #: file bytes, page index, dpi -> image bytes
    rasterise: Callable[[bytes, int, int], bytes] | None = None
    #: image bytes, box (left, top, right, bottom) -> image bytes
    crop: Callable[[bytes, tuple[int, int, int, int]], bytes] | None = None
    #: image bytes -> width, height
    measure: Callable[[bytes], tuple[int, int]] | None = None
    #: image bytes, prompt -> text, or None if the service does not answer
    vision: Callable[[bytes, str], str | None] | None = None
    #: texts, "document" or "query" -> vectors
    embed: Callable[[list[str], str], list[list[float]]] | None = None
    #: text -> exact number of tokens
    count_tokens: Callable[[str], int] | None = None
