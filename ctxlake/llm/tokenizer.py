"""Problem 7: encode every text with a public byte-level BPE vocabulary.

Method: the distinct words of a batch are walked in sorted order, which is a depth-first walk of their trie: what two
neighbours share is their path from the root, kept on a stack, so each shared prefix is encoded once. The state of a
trie node is the last token of its prefix's encoding; a child's last token is the longest vocabulary entry that ends
there and may stand after the last token of the node where it starts. Following the last tokens back gives the ids.

Defined results: null and empty texts give an empty list; text that looks like a special token is ordinary text; white
space is kept; repeated rows and repeated words give the same ids each time; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxlake.runtime import spread

#: The word pattern of this vocabulary, a fixed value: contractions, then letters, digits, other signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
MEMO_WORDS = 400_000


def vocabulary_path(name: str = DEFAULT_FILE, folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("CTXLAKE_TOKENIZERS", "/opt/tokenizers"), name)


class TrieBPE:
    """A byte-level BPE vocabulary given as ranks (base64 token, rank; one a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.word = regex.compile(PATTERN)
        self.longest = max(map(len, self.rank))
        self.tails = {t[i:] for t in self.rank for i in range(len(t))}
        self.bytes = {r: t for t, r in self.rank.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for t, r in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(t) == 1:
                self.parts[r] = (r, r)
            else:
                a, b = self._merge(t, r)
                self.parts[r] = (a, b)
                self.merged[a, b] = r
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}

    def _merge(self, t: bytes, below: int) -> list[int]:
        """Plain BPE with the ranks under ``below``: the two parts of a token."""
        ids = [self.rank[bytes([x])] for x in t]
        while len(ids) > 2:
            pairs = [(self.merged.get((ids[i], ids[i + 1]), below), i) for i in range(len(ids) - 1)]
            r, i = min(pairs)
            if r >= below:
                raise ValueError("the vocabulary has a token that merges can't reach")
            ids[i : i + 2] = [r]
        return ids

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a, b as they are when they stand side by side: undo merges from the later one
        down, and see whether a merge across the border would have come first."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        key, bound, ok = (a, b), 1 << 60, True
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < bound:
                ok = False
                break
            if a > b:
                bound, a = a, self.parts[a][1]
                if a == bound:
                    bound, b = b + 1, self.parts[b][0]
                    if b + 1 == bound:
                        break
            else:
                bound, b = b + 1, self.parts[b][0]
                if b + 1 == bound:
                    bound, a = a, self.parts[a][1]
                    if a == bound:
                        break
        if len(self.fits) > 4_000_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of sorted distinct words. last[d], back[d]: last token, and its length, of the path's first d bytes."""
        rank, tails, may = self.rank, self.tails, self.may_follow
        out, last, back, prev = [], [-1], [0], b""
        for w in words:
            d, most = 0, min(len(w), len(prev))
            while d < most and w[d] == prev[d]:
                d += 1
            del last[d + 1 :], back[d + 1 :]
            for end in range(d + 1, len(w) + 1):
                ends = []
                at = end - 1
                while at >= 0 and (tail := w[at:end]) in tails:
                    if (t := rank.get(tail)) is not None:
                        ends.append((t, end - at))
                    at -= 1
                for t, n in reversed(ends):
                    if end == n or may(last[end - n], t):
                        last.append(t)
                        back.append(n)
                        break
            ids, at = [], len(w)
            while at:
                ids.append(last[at])
                at -= back[at]
            out.append(ids[::-1])
            prev = w
        return out

    def learn(self, words: set[str]) -> None:
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.memo = {}
        new = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
        self.memo.update(zip((w for _, w in new), self.encode_words([b for b, _ in new])))

    def words_of(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text; afterwards the memo knows them all."""
        split = [self.word.findall(t) if t else [] for t in texts]
        words = set().union(*split)
        new = words - self.memo.keys()
        self.learn(words if len(self.memo) + len(new) > MEMO_WORDS else new)
        return split

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = self.words_of(texts)
        return [[i for w in ws for i in self.memo[w]] for ws in split]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        split = self.words_of(texts)
        return [sum([len(self.memo[w]) for w in ws]) for ws in split]


@lru_cache(maxsize=2)
def load(path: str) -> TrieBPE:
    """From the path where it lies on this machine, else from what the driver shipped."""
    return TrieBPE(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def ship(df: DataFrame, path: str) -> str:
    """Have a vocabulary file that lies on the driver sent to workers that do not have it; the path."""
    sc = df.sparkSession.sparkContext
    if os.path.exists(path) and sc.master != "local" and not sc.master.startswith("local["):
        sc.addFile(path)
    return path


def _slices(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``most`` bytes of text each."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    begin, size = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += int(n)
    if batch.num_rows > begin:
        yield begin, batch.num_rows


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ids: array of int."""
    file = ship(df, path or vocabulary_path())
    part = spread(df.select(F.col(id_col), F.col(text_col).cast("string").alias("_t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for b in batches:
            for lo, hi in _slices(b, 1):
                ids = bpe.encode_batch(b.column(1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return part.mapInArrow(run, part.select(id_col).schema.add("ids", T.ArrayType(T.IntegerType())))


def count_tokens(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """The ``keep`` columns and the number of ids of each text; 0 for null and empty texts."""
    file = ship(df, path or vocabulary_path())
    part = spread(df.select(*keep, F.col(text_col).cast("string").alias("_t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for b in batches:
            for lo, hi in _slices(b, b.num_columns - 1):
                n = bpe.count_batch(b.column(b.num_columns - 1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(b.num_columns - 1)), pa.array(n, pa.int64())], names=[*keep, out])

    return part.mapInArrow(run, part.drop("_t").schema.add(out, T.LongType()))
