"""Problem 4: the language of every item and of every stretch of it in another language.

Method: word-first backoff. A word of the word list scores by its logarithmic frequency in each language; an unseen word
falls back, place by place, to the longest character n-gram (five down to one) that any language's words hold. Sentences
sum up their words; a sentence much like its neighbours follows them (Viterbi with a cost for each change), and runs of
sentences of one language form a segment with its place, its characters and a confidence.

Running text: sentences of at least ``MIN_WORDS`` words written in letters only, of which the word list knows a part; and stretches of at
least ``MIN_CHARS`` characters of such sentences whatever the list knows, by n-grams alone. Where an item has neither, all its phrases outside tables
of two words, or of a known one, are judged together. Identifiers, paths, numbers, hexadecimal data and table cells are not words.

Defined results: null, empty and blank texts, and texts without running text, have no language; repeated rows of an item
give the same result once; the latest usable or unusable label counts (of two at the same time the greater text);
labels of unknown spelling are unusable; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxlake.runtime import spread

#: Codes and English and own names of the languages (fixed values). A region after - or _ does not matter.
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castilian"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
    "ru": ("ru", "rus", "russian", "русский"),
}
MIN_WORDS, MIN_CHARS = 4, 120
CHANGE_COST, CLIP, UNSEEN = 7.0, 6.0, 0.45
WORD_LIST = 2_000_000
#: How much the best language must be ahead where there are only phrases.
PHRASE_MARGIN = 1.5
MEMO = 500_000
UNIT = re.compile(r"(?<=[.!?:;])[\"»”')\]]*\s+|\n\s*\n|\n(?=#+ )|(?<=\d)\n|\|")
#: A word of letters only, not part of an identifier, a path or a number.
WORDS = re.compile(r"(?<![\w./\\@#`_-])[^\W\d_]+(?![\w/\\@]|[.][a-z]|\(\))")


class Model:
    """Log frequencies by language; vectors are relative to the best language and clipped, so no word decides alone."""

    def __init__(self, rows: list[tuple[str, str, float]], order: int = 5):
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        n = len(self.langs)
        freq: dict[str, np.ndarray] = {}
        grams: list[dict[str, np.ndarray]] = [{} for _ in range(order + 1)]
        for lang, word, f in rows:
            freq.setdefault(word, np.zeros(n))[at[lang]] += f
            w = f"^{word}$"
            for k in range(1, order + 1):
                for i in range(len(w) - k + 1):
                    grams[k].setdefault(w[i : i + k], np.zeros(n))[at[lang]] += np.log1p(f)
        total = sum(freq.values()) if freq else np.ones(n)
        self.known = {w: self.relative(np.log((c + 0.5) / total)) for w, c in freq.items()}
        self.grams = []
        for g in grams:
            t = sum(g.values()) if g else np.ones(n)
            self.grams.append({k: np.log((c + 0.5) / (t + 0.5 * max(1, len(g)))) for k, c in g.items()})
        self.order = order
        self.index: dict[str, int] = {}
        self.vectors: list[np.ndarray] = []
        self.table = np.zeros((0, n))
        self.seen = np.zeros(0, bool)
        self.flags: list[bool] = []

    @staticmethod
    def relative(v: np.ndarray) -> np.ndarray:
        return np.maximum(v - v.max(), -CLIP)

    def score(self, word: str) -> np.ndarray:
        v = self.known.get(word)
        if v is not None:
            return v
        w, s, places = f"^{word}$", np.zeros(len(self.langs)), 0
        for i in range(len(w) - 1):
            for k in range(min(self.order, len(w) - i), 0, -1):
                g = self.grams[k].get(w[i : i + k])
                if g is not None:
                    s += (g - g.max()) * (k / self.order)
                    places += 1
                    break
        return np.maximum((s - s.max()) * UNSEEN, -CLIP / 2) if places else s

    def place(self, word: str) -> int:
        i = self.index.get(word)
        if i is None:
            i = self.index[word] = len(self.vectors)
            self.vectors.append(self.score(word))
            self.flags.append(word in self.known)
        return i

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.table) < len(self.vectors):
            new = len(self.table)
            self.table = np.vstack([self.table, *[v[None] for v in self.vectors[new:]]]) if len(self.vectors) - new < 4 else np.vstack([self.table, np.array(self.vectors[new:])])
            self.seen = np.array(self.flags)
        return self.table, self.seen

    def trim(self) -> None:
        if len(self.index) > MEMO:
            self.index, self.vectors, self.flags = {}, [], []
            self.table, self.seen = np.zeros((0, len(self.langs))), np.zeros(0, bool)


def viterbi(scores: np.ndarray) -> np.ndarray:
    best, back = scores[0].copy(), []
    for s in scores[1:]:
        top = int(best.argmax())
        change = best[top] - CHANGE_COST
        stay = best >= change
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, change) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def units_of(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of each sentence, heading or table cell."""
    at = 0
    for m in UNIT.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def confidence(scores: np.ndarray, words: float, lang: int) -> float:
    s = scores / max(1.0, float(words) ** 0.5)
    p = np.exp(s - s.max())
    return float(p[lang] / p.sum())


def phrases(model: Model, text: str) -> list[tuple[int, int, int, int, float]]:
    """One segment of a text without running sentences, from its short phrases; none if they hold no evidence."""
    total, words, spans = np.zeros(len(model.langs)), 0, []
    for row in re.finditer(r"[^\n]+", text):
        if row[0].lstrip().startswith("|") or "\t" in row[0]:
            continue
        for a, b in units_of(row[0]):
            found = WORDS.findall(row[0][a:b].lower())
            if len(found) >= 2 or any(w in model.known for w in found):
                total += sum(model.score(w) for w in found)
                words += len(found)
                spans.append((row.start() + a, row.start() + b))
    if not spans or total.max() - np.sort(total)[-2:].min() < PHRASE_MARGIN:
        return []
    lang = int(total.argmax())
    return [(lang, spans[0][0], spans[-1][1], sum(b - a for a, b in spans), confidence(total, words, lang))]


def segments_of(model: Model, texts: list[str | None]) -> Iterator[list[tuple[int, int, int, int, float]]]:
    """For each text its segments: (language, begin, end, characters, confidence)."""
    model.trim()
    ids, starts, begins, ends, owner = [], [], [], [], []
    place, index = model.place, model.index
    for t, text in enumerate(texts):
        if not text:
            continue
        for a, b in units_of(text):
            words = WORDS.findall(text[a:b].lower())
            if len(words) >= MIN_WORDS:
                starts.append(len(ids))
                ids += [index[w] if w in index else place(w) for w in words]
                begins.append(a)
                ends.append(b)
                owner.append(t)
    by: dict[int, list[int]] = {}
    if starts:
        table, seen = model.matrix()
        ids_a, lengths, of = np.array(ids), np.array(ends) - np.array(begins), np.array(owner)
        scores = np.add.reduceat(table[ids_a], starts)
        counts = np.diff([*starts, len(ids)])
        known = np.add.reduceat(seen[ids_a].astype(np.int64), starts)
        running = (known >= 2) & (known * 5 >= counts)
        # Sentences one after another that the list does not know enough of count if there is much of them.
        stretch = np.cumsum(running | np.concatenate([[True], of[1:] != of[:-1]]) | np.concatenate([[True], running[:-1]]))
        much = np.bincount(stretch, np.where(running, 0, lengths))[stretch] >= MIN_CHARS
        at = np.flatnonzero(running | much)
        by = {t: list(g) for t, g in groupby(at.tolist(), key=lambda i: owner[i])}
        best = scores.argmax(1)
    for t, text in enumerate(texts):
        units = by.get(t)
        if not units:
            yield phrases(model, text) if text and text.strip() else []
            continue
        own = best[units]
        path = own if (own == own[0]).all() else viterbi(scores[units])
        out, i = [], 0
        while i < len(units):
            j = i
            while j < len(units) and path[j] == path[i]:
                j += 1
            part = units[i:j]
            out.append((int(path[i]), begins[part[0]], ends[part[-1]], int(lengths[part].sum()) + j - i - 1, confidence(scores[part].sum(0), counts[part].sum(), path[i])))
            i = j
        yield out


def label_code(c: Column) -> Column:
    """Two-letter code of a declared language; null where it says nothing."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([^\s_()-]+)([-_(\s].*)?$", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(base.isin(*names), F.lit(code)).otherwise(out)
    return out


def latest_labels(labels: DataFrame) -> DataFrame:
    """item_kind, item_id, label: one row an item, by the label's time."""
    return labels.groupBy("item_kind", "item_id").agg(F.max(F.struct("labelled_at", "lang")).alias("m")).select("item_kind", "item_id", label_code(F.col("m.lang")).alias("label"))


def segments(items: DataFrame, words: DataFrame) -> DataFrame:
    """From items (item_kind, item_id, text) and a word list (lang, word, freq; a small table by its nature, of at most WORD_LIST rows): item_kind, item_id, segments: array of (lang, begin, end, chars, confidence)."""
    rows = [(r.lang, r.word, float(r.freq)) for r in words.where("lang IS NOT NULL AND word IS NOT NULL AND freq > 0").select("lang", F.lower("word").alias("word"), "freq").limit(WORD_LIST + 1).collect()]
    if len(rows) > WORD_LIST:
        raise ValueError(f"a word list of more than {WORD_LIST} rows is too large to be sent to every worker")
    kind = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("chars", pa.int64()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(rows)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                out = [[{"lang": model.langs[g], "begin": a, "end": b, "chars": n, "confidence": round(c, 4)} for g, a, b, n, c in s] for s in segments_of(model, part.column(2).to_pylist())] if rows else [[]] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, kind)], names=["item_kind", "item_id", "segments"])

    return spread(items.select("item_kind", "item_id", "text")).mapInArrow(run, "item_kind string, item_id long, segments array<struct<lang:string,begin:long,end:long,chars:long,confidence:double>>")


def languages(items: DataFrame, words: DataFrame, labels: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each item and language that counts: item_kind, item_id, lang, chars, confidence, n_langs, label. A language counts if it is the
    only one of the item or has ``min_chars`` characters of it."""
    # The latest label travels in the same shuffle as the item's text does not: segments are made before the join.
    s = segments(items, words).where(F.size("segments") > 0).dropDuplicates(["item_kind", "item_id"])
    s = s.join(latest_labels(labels), ["item_kind", "item_id"], "left")
    one = s.select("item_kind", "item_id", "label", F.explode("segments").alias("s")).groupBy("item_kind", "item_id", "label", F.col("s.lang").alias("lang"))
    g = one.agg(F.sum("s.chars").alias("chars"), (F.sum(F.col("s.chars") * F.col("s.confidence")) / F.sum("s.chars")).alias("confidence"))
    g = g.groupBy("item_kind", "item_id", "label").agg(F.collect_list(F.struct("chars", "lang", "confidence")).alias("l"))
    counts = F.filter("l", lambda x: (F.size("l") == 1) | (x["chars"] >= min_chars))
    counts = F.when(F.size(counts) > 0, counts).otherwise(F.slice(F.sort_array("l", False), 1, 1))
    g = g.select("item_kind", "item_id", "label", counts.alias("l"))
    return g.select("item_kind", "item_id", "label", F.size("l").alias("n_langs"), F.array_contains(F.transform("l", lambda x: x["lang"]), F.col("label")).alias("fits"), F.explode("l").alias("x")).select(
        "item_kind", "item_id", "x.lang", "x.chars", F.round("x.confidence", 4).alias("confidence"), "n_langs", "label", F.coalesce("fits", F.lit(False)).alias("label_fits")
    )


def mislabelled(items: DataFrame, words: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of languages() of items without a usable label, with a wrong one, or with more than one language."""
    return languages(items, words, labels).where("label IS NULL OR NOT label_fits OR n_langs > 1")
