"""Problem 2: cut oversized texts into pieces at natural boundaries, with an overlap.

Method: every position of a text has a boundary strength (paragraph, line, sentence, clause, word, none). A sparse
table answers "which is the strongest cut in this window" in constant time, ties going to the right; the next piece
steps back by the overlap. Texts go through in blocks of bounded size, so a text of any length needs bounded memory.

Defined results: only texts over the limit give rows. Length counts code points without white space at both ends; tokens
are code points / 4, rounded half to even. Null, empty and blank texts give no rows; a text without any boundary is cut
at the limit, though not in front of a combining mark; repeated rows each give their pieces; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxlake.functions.text import strip

BLOCK = 1 << 18
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD = 6, 5, 4, 3, 2
_SPACE = np.array([ord(c) for c in map(chr, range(0x3001)) if c.isspace()], np.uint32)
_END = np.array([ord(c) for c in ".!?…。"], np.uint32)
_CLAUSE = np.array([ord(c) for c in ",;:)]»”"], np.uint32)
_CLOSE = np.array([ord(c) for c in ")]»”\"'"], np.uint32)


def tokens(n_chars):
    return np.where(n_chars == 0, 0, np.maximum(1, np.rint(n_chars / 4.0))).astype(np.int64)


def limit_chars(limit_tokens: int) -> int:
    """The most code points that come to no more than ``limit_tokens``: 4n+2 rounds to the even neighbour."""
    n = 4 * limit_tokens + 2
    return n if round(n / 4.0) <= limit_tokens else n - 1


def strengths(cp: np.ndarray) -> np.ndarray:
    """For each position i, how well the text may be cut in front of i; a cut lies after white space, at a word's start."""
    space = np.isin(cp, _SPACE)
    s = np.zeros(len(cp), np.int8)
    start = np.zeros(len(cp), bool)
    start[1:] = space[:-1] & ~space[1:]
    at = np.flatnonzero(start)
    if len(at):
        s[at] = WORD
        lines = np.concatenate([[0], np.cumsum(cp == 10)])
        words = np.flatnonzero(~space)
        last = np.searchsorted(words, at) - 1  # the last visible character before the cut
        ok = last >= 0
        at, last = at[ok], words[last[ok]]
        breaks = lines[at] - lines[last]
        before = np.where(np.isin(cp[last], _CLOSE) & (last > 0), cp[np.maximum(last - 1, 0)], cp[last])
        s[at] = np.select([breaks >= 2, breaks == 1, np.isin(before, _END), np.isin(cp[last], _CLAUSE)], [PARAGRAPH, LINE, SENTENCE, CLAUSE], WORD)
    return s


class RangeMax:
    """Sparse table over strengths: level j holds the place of the strongest cut among 2**j, rightmost first."""

    def __init__(self, s: np.ndarray, longest: int):
        self.s = s
        self.levels = [np.arange(len(s), dtype=np.int32)]
        j = 1
        while (1 << j) <= min(longest, len(s)):
            a, half = self.levels[-1], 1 << (j - 1)
            left, right = a[: len(a) - half], a[half:]
            self.levels.append(np.where(s[left] > s[right], left, right))
            j += 1

    def best(self, lo: int, hi: int) -> int:
        """The strongest place in [lo, hi)."""
        j = (hi - lo).bit_length() - 1
        a, b = int(self.levels[j][lo]), int(self.levels[j][hi - (1 << j)])
        return a if self.s[a] > self.s[b] else b


def pieces(text: str, limit: int, overlap: int, least: float = 0.5) -> list[tuple[int, int]]:
    """Begin and end of each piece of the stripped ``text``. A piece has at most limit_chars(limit) code points, ends at
    the strongest boundary of the window's last half (of the rest of the window where that half has none) and begins, at a word's start,
    at most 4 * ``overlap`` before the end of the one before it."""
    most, n = limit_chars(limit), len(text)
    back = max(0, min(4 * overlap, most - 2))
    block = max(BLOCK, 2 * (most + back + 2))
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out, begin, base, table, s = [], 0, 0, None, None
    while n - begin > most:
        if table is None or begin + most + 1 > base + len(s):
            base = max(0, begin - back - 1)
            s = strengths(cp[base : base + block])
            table = RangeMax(s, most)
        lo, hi = begin + max(back + 1, int(most * least)), begin + most
        cut = base + table.best(lo - base, hi + 1 - base)
        if s[cut - base] == 0 and lo > begin + back + 1:
            early = base + table.best(begin + back + 1 - base, lo - base)
            cut = early if s[early - base] else cut
        if s[cut - base] == 0:
            cut = hi
            while cut > lo and unicodedata.combining(text[cut]):
                cut -= 1
        out.append((begin, cut))
        step = np.flatnonzero(s[cut - back - base : cut - base] > 0)
        begin = cut - back + int(step[0]) if len(step) else cut - back if back and s[cut - base] == 0 else cut
    out.append((begin, n))
    return out


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", limit: int = 500, overlap: int = 50, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: the id, ``extra`` columns, piece_index, n_pieces, begin, end (in the stripped text), piece_text, piece_tokens.
    Only texts over ``limit`` tokens leave the JVM."""
    big = df.where(F.length(text_col) > limit_chars(limit)).select(F.col(id_col).alias("id"), *[F.col(c) for c in extra], strip(text_col).alias("_t"))
    big = big.where(F.length("_t") > limit_chars(limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, idx, of, begin, end, text = [], [], [], [], [], []
            for r, t in enumerate(b.column("_t").to_pylist()):
                ps = pieces(t, limit, overlap)
                row += [r] * len(ps)
                idx += range(len(ps))
                of += [len(ps)] * len(ps)
                begin += [p[0] for p in ps]
                end += [p[1] for p in ps]
                text += [t[p[0] : p[1]].strip() for p in ps]
            if row:
                keep = [b.column(i).take(pa.array(row)) for i in range(b.num_columns - 1)]
                toks = tokens(np.array([len(t) for t in text]))
                cols = [*keep, pa.array(idx, pa.int32()), pa.array(of, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(text, pa.string()), pa.array(toks, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "piece_index", "n_pieces", "begin", "end", "piece_text", "piece_tokens"])

    schema = big.drop("_t").schema
    for name, kind in (("piece_index", T.IntegerType()), ("n_pieces", T.IntegerType()), ("begin", T.LongType()), ("end", T.LongType()), ("piece_text", T.StringType()), ("piece_tokens", T.LongType())):
        schema = schema.add(name, kind)
    return big.mapInArrow(run, schema).withColumnRenamed("id", id_col)
