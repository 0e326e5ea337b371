"""All tunables, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    #: Thresholds and limits (fixed values).
    min_native_chars: int = 20
    ocr_confidence: float = 70.0
    ocr_min_words: int = 5
    retry_confidence: float = 80.0
    retry_min_words: int = 3
    render_dpi: float = 150.0
    image_max_edge: float = 1568.0
    image_divisor: float = 750.0
    chars_per_token: float = 4.0
    chunk_tokens: int = 500
    overlap_tokens: int = 50
    top_k: int = 5
    activity_window: int = 10
    activity_keep: int = 500
    max_lines: int = 40
    tail_lines: int = 5
    boilerplate_fraction: float = 0.8
    boilerplate_min_pages: int = 3
    boilerplate_max_chars: int = 120
    large_doc_tokens: int = 8000
    head_tokens: int = 1500
    figure_min_side: float = 48.0
    duplicate_min_chars: int = 40
    tag: str = "[ctxlake]"
    #: Suffixes of files that are distilled (fixed values).
    image_suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".tiff", ".tif", ".bmp", ".webp")
    pdf_suffixes: tuple[str, ...] = (".pdf",)

    @property
    def distillable(self) -> tuple[str, ...]:
        return self.image_suffixes + self.pdf_suffixes


DEFAULT = EngineConfig()
