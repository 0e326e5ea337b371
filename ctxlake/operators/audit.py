"""Audit of notes: sizes, repeated paragraphs, files nobody refers to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ctxlake.config import DEFAULT, EngineConfig
from ctxlake.functions.text import collapse_space, text_tokens

#: Bits of the filter of names: 16 MB, however many names there are.
FILTER_BITS = 1 << 27
#: Findings of a kind that a report shows, and places of a repeated paragraph.
FINDINGS, PLACES = 10, 20


def files(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, bytes, tokens, lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(path).alias("path"), F.octet_length(t).cast("long").alias("bytes"), text_tokens(t).alias("tokens"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"))


def places(df: DataFrame, path: str = "path", text: str = "text", separator: str = "\n\n", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """hash, path, i, place: every paragraph that is long enough, by its hash after white space and case are levelled."""
    p = df.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), separator, -1)).alias("i", "p"))
    n = p.select("path", "i", collapse_space("p").alias("norm")).where(F.length("norm") >= cfg.duplicate_min_chars)
    return n.select(F.sha1(F.col("norm").cast("binary")).alias("hash"), "path", "i", F.concat(F.col("path"), F.lit(": "), F.substring("norm", 1, 60), F.lit("...")).alias("place"))


def duplicates(df: DataFrame, path: str = "path", text: str = "text", separator: str = "\n\n", cfg: EngineConfig = DEFAULT, shown: int = PLACES) -> DataFrame:
    """hash, occurrences, snippet, locations: paragraphs that occur more than once, with their first place and their ``shown`` first places. Counts are
    aggregates and ranks with a limit are cut down in every task, so a paragraph in a third of all files is no problem; places() has all of them."""
    p = places(df, path, text, separator, cfg)
    n = p.groupBy("hash").agg(F.count("*").alias("occurrences")).where("occurrences > 1")
    first = p.withColumn("r", F.row_number().over(W.Window.partitionBy("hash").orderBy("path", "i"))).where(F.col("r") <= shown)
    first = first.groupBy("hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "place"))), lambda x: x["place"]).alias("locations"))
    return n.join(first, "hash").select("hash", "occurrences", F.element_at("locations", 1).alias("snippet"), "locations")


class Windows:
    """Hashes of all substrings of a length: sums of powers, so each length takes a few operations on whole arrays."""

    P = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            for name, base in (("up", self.P), ("down", pow(self.P, -1, 1 << 64))):
                setattr(self, name, np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)]))

    def sums(self, text: str) -> np.ndarray:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.powers(len(cp))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((cp + np.uint64(1)) * self.up[: len(cp)], dtype=np.uint64)])

    def bits(self, sums: np.ndarray, length: int) -> np.ndarray:
        h = (sums[length:] - sums[: len(sums) - length]) * self.down[: len(sums) - length]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(37)).astype(np.int64)


def _stem_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    w = Windows()
    for b in batches:
        bit = np.array([w.bits(w.sums(s), len(s))[0] for s in b.column(0).to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.left_shift(np.int64(1), bit & 63))], names=["word", "mask"])


def _mentions(lengths: list[int], words: np.ndarray, slab: int = 1 << 20):
    """other, stem: the substrings of each text that may be a stem. Texts go one after another in slabs of about a million characters; what reaches over the end of a
    text is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows()
        for b in batches:
            others, texts, lo = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            while lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size + len(texts[hi]) <= slab:
                    size += len(texts[hi])
                    hi += 1
                whole, ends = "".join(texts[lo:hi]), np.cumsum([len(t) for t in texts[lo:hi]])
                sums, found = w.sums(whole), set()
                for n in lengths:
                    if n <= len(whole):
                        bit = w.bits(sums, n)
                        at = np.flatnonzero((words[bit >> 6] >> (bit & 63)) & 1)
                        of = np.searchsorted(ends, at, "right")
                        inside = at + n <= ends[of]
                        found.update((others[lo + t], whole[i : i + n]) for i, t in zip(at[inside].tolist(), of[inside].tolist()))
                rows = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["other", "stem"])
                lo = hi

    return run


def orphans(notes: DataFrame, others: DataFrame, key: str = "path") -> DataFrame:
    """Notes (path) whose name without its suffix occurs in no other text (path, text). Each text is read once: the hashes of its substrings of the
    lengths that names have go through a filter of fixed size, and what passes is joined with the names, after partial aggregation to the least and the greatest
    path that holds it. The driver gets the filter (at most 16 MB) and the different lengths of names.

    Defined results: an empty name is in every other text; a note's own text does not count; null paths and texts take no part; a path given twice is
    one note."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(key), "/"), -1), r"\.[^.]*$", "")
    n = notes.where(F.col(key).isNotNull()).select(F.col(key).alias("path"), stem.alias("stem")).distinct()
    texts = others.where("text IS NOT NULL").where(F.col(key).isNotNull()).select(F.col(key).alias("other"), "text")
    named = n.where("stem <> ''").select("stem").distinct()
    lengths = sorted(r.n for r in named.select(F.length("stem").alias("n")).distinct().collect())
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in named.mapInArrow(_stem_bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        words[r.word] = r.mask
    hit = texts.mapInArrow(_mentions(lengths, words), "other string, stem string").groupBy("stem").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    every = texts.agg(F.min("other").alias("lo"), F.max("other").alias("hi")).select(F.lit("").alias("stem"), "lo", "hi").where("lo IS NOT NULL")
    mentioned = n.join(hit.unionByName(every), "stem").where("lo <> path OR hi <> path")
    return n.select("path").join(mentioned.select("path"), "path", "left_anti")


def report(notes: DataFrame, mode: str, memory: DataFrame | None = None, shown: int = FINDINGS, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """section (its place), kind, n, rank, finding: sizes of the notes (path, text), then repeated paragraphs and orphans among ``memory`` (path, text), at most
    ``shown`` of each with the number of all; while reviewing or doing infrastructure work, orphans come before repeated paragraphs."""
    every = notes if memory is None else notes.unionByName(memory)
    size = files(notes).select(F.col("path").alias("k"), F.concat(F.col("path"), F.lit(": "), F.col("bytes").cast("string"), F.lit(" bytes, ~"), F.col("tokens").cast("string"), F.lit(" tokens, "), F.col("lines").cast("string"), F.lit(" lines")).alias("finding"))
    twice = duplicates(every, cfg=cfg).select(F.col("snippet").alias("k"), F.concat(F.col("occurrences").cast("string"), F.lit("x: "), F.col("snippet")).alias("finding"))
    parts = [("size", 0, size, None), ("repeated", 2 if mode in ("review", "infra") else 1, twice, shown)]
    if memory is not None:
        parts.append(("orphan", 1 if mode in ("review", "infra") else 2, orphans(memory, every).select(F.col("path").alias("k"), F.col("path").alias("finding")), shown))
    out = None
    for kind, at, found, most in parts:
        n = found.agg(F.count("*").alias("n"))
        top = found.orderBy("k", "finding").limit(most) if most else found
        rows = top.crossJoin(F.broadcast(n)).select(F.lit(at).alias("section"), F.lit(kind).alias("kind"), "n", "finding")  # one row
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("section", "finding")
