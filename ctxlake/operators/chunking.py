"""Overlapping chunks of a token budget. Paragraphs are packed while they fit; a longer one is cut between words, carrying whole words back;
at last every chunk but the first gets the tail of the one before it in front."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxlake.backends import Backends
from ctxlake.config import DEFAULT, EngineConfig
from ctxlake.functions.text import text_tokens
from ctxlake.runtime import spread


def cut_words(paragraph: str, size: int, overlap: int) -> list[str]:
    words = paragraph.split()
    ends = [0]
    for w in words:
        ends.append(ends[-1] + len(w) + 1)
    out, lo = [], 0
    for k in range(len(words)):
        if k > lo and ends[k + 1] - ends[lo] > size:
            out.append(" ".join(words[lo:k]))
            first, lo = lo, k
            while overlap > 0 and lo > first and ends[k] - ends[lo - 1] <= overlap:
                lo -= 1
    return out + ([" ".join(words[lo:])] if words else [])


def chunks_of(text: str, size: int, overlap: int) -> list[str]:
    """Base chunks, without the tails."""
    out, packed = [], ""
    for p in text.split("\n\n"):
        if not p.strip():
            continue
        long = len(p) > size
        if packed and (long or len(packed) + 2 + len(p) > size):
            out += [packed.strip()] if packed.strip() else []
            packed = ""
        if long:
            out += cut_words(p, size, overlap)
        else:
            packed = f"{packed}\n\n{p}" if packed else p
    return out + ([packed.strip()] if packed.strip() else [])


def chunk(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """id, chunk_index, text, token_count. Null and blank texts have no chunks. Only whole texts go to Python, in Arrow batches; there is
    no shuffle: the tails come from the neighbours in the same array."""
    size, overlap = int(cfg.chunk_tokens * cfg.chars_per_token), int(cfg.overlap_tokens * cfg.chars_per_token)
    part = spread(df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("_t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([chunks_of(t, size, overlap) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=[id_col, "c"])

    base = part.mapInArrow(run, part.select(id_col).schema.add("c", T.ArrayType(T.StringType())))
    if overlap > 0:
        tailed = F.transform("c", lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.right(F.get("c", i - 1), F.lit(overlap)), F.lit("\n\n"), x)))
        base = base.withColumn("c", tailed)
    return base.select(id_col, F.posexplode("c").alias("chunk_index", "text")).withColumn("token_count", text_tokens("text"))


def chunk_rows(packed: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """chunk_id, source_path, chunk_index, text, token_count, indexed_at of a packed tree (path, route, text). The id is a hash of source and place, so
    another run over the same tree gives the same ids; all rows of a run have one time."""
    c = chunk(packed.where("route <> 'skip'"), "path", "text", cfg)
    return c.select(F.xxhash64("path", "chunk_index").alias("chunk_id"), F.col("path").alias("source_path"), "chunk_index", "text", "token_count", F.current_timestamp().alias("indexed_at"))


def embedded(chunks: DataFrame, backends: Backends, model: str, kind: str = "document", size: int = 128) -> DataFrame:
    """chunk_id, model, vector, error: by the embedding service, ``size`` texts at a time; without one, or where it fails, the vector is null and the
    error says why, so that the keyword index stands alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(ids), size):
                part, error = ids[lo : lo + size], None
                try:
                    if backends.embed is None:
                        raise ValueError("no embedding service")
                    vectors = [[float(x) for x in v] for v in backends.embed([t or "" for t in texts[lo : lo + size]], kind)]
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                except Exception as e:
                    vectors, error = [None] * len(part), f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([model] * len(part)), pa.array(vectors, pa.list_(pa.float32())), pa.array([error] * len(part), pa.string())], names=["chunk_id", "model", "vector", "error"])

    return chunks.select(F.col("chunk_id").cast("long"), "text").mapInArrow(run, "chunk_id long, model string, vector array<float>, error string")


def exact_counts(rows: DataFrame, backends: Backends, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, estimate, exact, error: the exact number of tokens by the counting service; without one, or where it fails, null with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exact, errors = [], []
            for t in b.column(2).to_pylist():
                n = error = None
                try:
                    if backends.count_tokens is None:
                        raise ValueError("no counting service")
                    n = int(backends.count_tokens(t or ""))
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"[:500]
                exact.append(n)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(exact, pa.int64()), pa.array(errors, pa.string())], names=[id_col, "estimate", "exact", "error"])

    part = rows.select(id_col, text_tokens(text_col).alias("estimate"), F.col(text_col).alias("_t"))
    schema = part.select(id_col, "estimate").schema.add("exact", T.LongType()).add("error", T.StringType())
    return part.mapInArrow(run, schema)
