"""Problem 6: repair text read from scanned pages.

Method: an averaged perceptron edits characters. For every character of a suspicious word it predicts keep, delete, replace by x
or insert x; for the blank or the hyphen and line end between two word parts, keep or join. It is trained here, on a bounded sample:
words of the corpus that its trusted texts do not know, aligned with near words that they do know, beside words to be kept. A
correction counts only if it leads to a known word. A hyphen at a line end stays where the vocabulary knows the compound or both of
its parts, goes where it knows the whole word, and is left to the perceptron elsewhere.

Running lines and page numbers go by their place: on a page, among the first or last lines; in a chunk, which may hold page
borders anywhere, by its ends, blank lines and page numbers beside. The better a line is set off, the less its form matters. A running
line must recur in items of the same original too, apart from digits and misread characters.

Statistics cover all data: the vocabulary counts in how many trusted originals each word occurs, and lines are counted over all items. Only the perceptron's examples are a sample.

Defined results: null, empty and blank texts have no damage and stay as they are; rows delivered twice count once; an item
without key has no running lines; with no trusted text at all nothing counts as misread and every word part before a mark at a line end is
joined to the next; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlake.runtime import checkpointed, sample_by_hash, spread

#: Parts of all trusted originals that hold a known word in lower case, or capitalised; and the smallest number of them.
KNOWN_PART, KNOWN_SPREAD, KNOWN_COUNT = 1.5e-3, 6e-3, 3
#: Items from which the perceptron's examples come, and how many examples it gets.
SAMPLE_ITEMS, EXAMPLES, ROUNDS = 4000, 12_000, 4
#: Part of all different words that hold a usual sequence of three letters.
GRAM_PART = 2e-4
#: Part of all edits that an edit makes up if it is a confusion of the scanner; rarer ones come from names near a known word.
EDIT_PART = 0.005
#: Least gain of an edit over keeping the character, for words that may be names.
NAME_GAIN = -20.0
ROWS = 1 << 14
MISREADS = 3
RECURS = 3
#: Lines from either end of a page that count as its edge.
EDGE = 3

MARKS = "-‐\xad¬"
#: A mark behind a letter at a line end, and what follows it in the next line; a blank after that becomes the line break.
BREAK = re.compile(rf"[{MARKS}](?<=[^\W\d_].)[ \t]*\n([^\W\d_]\S*) ?")
LETTERS, LAST_LETTERS = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_]+\Z")
#: Gains from which a blank within a word, and a hyphen at a line end between parts the vocabulary does not know, are deleted.
JOIN_GAIN, BREAK_GAIN = -10.0, 0.0
#: Words for "page" before a page number (fixed values).
PAGE_WORDS = ("page", "seite", "página", "pagina", "blz", "стр", "страница", "p", "pp", "pg", "pag", "s", "f", "blatt", "hoja", "folio", "bladzijde", "sheet")
ROMAN = re.compile(r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_NUMBER = r"[0-9OoIlSsBb]{1,4}"
_FRAME = r"[-–—·•\[\](){}|.*~_ ]{0,3}"
NUMBER_LINE = re.compile(rf"{_FRAME}(?:([^\W\d_]{{1,10}})[.:]?\s*)?{_FRAME}({_NUMBER})(?:\s*(?:/|of|von|de|di|van|из|sur|-)\s*({_NUMBER}))?{_FRAME}")
TABLE_ROW = re.compile(r"\s*(?:\|.*\||[^\W\d_][\w-]*\s{2,}[\d.,]+%?|\S+(?:\t\S+)+)\s*")
SHORT_ROW = re.compile(r"\s*[\d.,]+%?\s*")
#: A token of running text: letters, possibly with foreign signs inside, not part of an identifier or path.
TOKEN = re.compile(r"(?<![^\s(\[{«»\"“”„‘'’`])[(\[{«\"“„‘'`]*([^\W_][^\s/\\_#=(){}\[\]<>]*)")
OPENING = re.compile(r"^[(\[{«\"“„‘'`]+")
TRAIL = re.compile(r"[.,;:!?)\]}»\"”“'’`…]+$")
WORD = re.compile(r"[^\W_]+")
#: Signs that stray into words, and the letters that digits and @ are taken for (fixed values).
INSIDE = re.compile(r"[~'|.`](?<=[^\W_].)(?=[^\W_])")
SHAPES_OF_DIGITS, SHAPES_OF_SIGNS = str.maketrans("01345678", "oleasbtb") | {ord("9"): "g"}, str.maketrans("@", "a")
#: A word with a sign among its letters that no spelling has there.
SIGN_INSIDE = re.compile(r"[^\W\d_]+[@~|`][^\W\d_]+")
#: A word with one digit among its letters: no identifier of running text looks so, a misread name does.
DIGIT_INSIDE = re.compile(r"(?=.{4})(?:[^\W\d_]+\d[^\W\d_]*|\d[^\W\d_]{3,})")
NAME = re.compile(r"(?<![^\W_])[^\W\d_a-z][^\W\d_]+(?![^\W_])")
NUMBER_AT_END = re.compile(r"^[\W_]*\d{1,4}\s{2,}|\s{2,}\d{1,4}[\W_]*$")
PARTS = re.compile("['’-]")
HASHLIKE = re.compile(r"[0-9a-f]{7,}|v\d.*|[^\W\d_]*\d{2,}[^\W\d_]*", re.I)


# ---------------------------------------------------------------- the perceptron


def bare(w: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def _features_of(words: list[str]) -> np.ndarray:
    """Row numbers in the weight table, [characters of all words, features]."""
    c = np.frombuffer(("\0\0" + "\1\1".join(words) + "\1\1").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([len(w) for w in words])
    x = np.arange(lengths.sum()) + 2 + 2 * np.repeat(np.arange(len(words)), lengths)
    x, l1, l2, r1, r2 = c[x], c[x - 1], c[x - 2], c[x + 1], c[x + 2]
    parts = [x, x * 7919 + l1 * 104729 + 1, x * 7919 + r1 * 1299709 + 2, x * 31 + l1 * 104729 + r1 * 1299709 + 3, x * 31 + l1 * 104729 + l2 * 15485863 + 4, x * 31 + r1 * 1299709 + r2 * 15485863 + 5, x * 0 + l1 * 104729 + r1 * 1299709 + 6]
    f = np.stack(parts, 1)
    return ((f * 2654435761) >> 11) % ROWS


class Editor:
    """Operations: "" keep, "-" delete (also: join at a blank or line end), "=x" or "=xy" replace, "+x" keep and insert x."""

    def __init__(self, ops: list[str], weights: np.ndarray, seen: dict[str, list[int]]):
        self.ops, self.w = ops, np.asarray(weights, np.float32)
        self.seen = {c: np.array(o) for c, o in seen.items()}

    @classmethod
    def train(cls, examples: list[tuple[str, list[str]]], rounds: int = ROUNDS, seed: int = 5) -> Editor:
        seen = Counter(o for _, ops in examples for o in ops)
        ops = ["", "-", *sorted(o for o in seen if o not in ("", "-"))]
        at = {o: i for i, o in enumerate(ops)}
        w, total, last, step = np.zeros((ROWS, len(ops)), np.float32), np.zeros((ROWS, len(ops)), np.float32), np.zeros((ROWS, len(ops)), np.int32), 0
        data = [(_features_of([x]), np.array([at[o] for o in y])) for x, y in examples]
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            for i in rng.permutation(len(data)):
                f, y = data[i]
                p = w[f].sum(1).argmax(1)
                step += 1
                for k in np.flatnonzero(p != y):
                    for cls_, d in ((y[k], 1.0), (p[k], -1.0)):
                        rows = f[k]
                        total[rows, cls_] += w[rows, cls_] * (step - last[rows, cls_])
                        last[rows, cls_] = step
                        np.add.at(w[:, cls_], rows, d)
        total += w * (step - last)
        by: dict[str, set[int]] = {}
        for x, y in examples:
            for c, o in zip(x, y):
                if o:
                    by.setdefault(c, set()).add(at[o])
        return cls(ops, total / max(1, step), {c: sorted(o) for c, o in by.items()})

    def join_gain(self, a: str, between: str, b: str) -> float:
        """How much deleting what is between two parts is preferred to keeping it."""
        s = self.scores([a + between + b])[len(a) : len(a) + len(between)]
        return float((s[:, 1] - s[:, 0]).sum())

    def scores(self, words: list[str]) -> np.ndarray:
        """[characters of all words, operations]"""
        f = _features_of(words)
        s = self.w[f[:, 0]]
        for k in range(1, f.shape[1]):
            s += self.w[f[:, k]]
        return s

    def proposals(self, words: list[str], per_char: int = 3) -> Iterator[tuple[str, list[list[tuple[float, str]]]]]:
        """For each word its best reading and, for each character, the likeliest operations among those that the examples
        held for it: (gain over keeping, what to write)."""
        if not words:
            return
        s = self.scores(words)
        chars = np.array([ord(c) for w in words for c in w])
        kinds, kind = np.unique(chars, return_inverse=True)
        allowed = np.zeros((len(kinds), len(self.ops)), bool)
        for k, c in enumerate(kinds):
            allowed[k, self.seen.get(chr(c), ())] = True
        best = s.argmax(1)
        gain = np.where(allowed[kind], s - s[:, :1], -np.inf)
        n = min(per_char, gain.shape[1])
        top = np.argpartition(-gain, n - 1, 1)[:, :n]
        g = np.take_along_axis(gain, top, 1)
        best, top, g, at = best.tolist(), top.tolist(), g.tolist(), 0
        write = [lambda c: c, lambda c: "", *((lambda c, x=o[1:]: x) if o[0] == "=" else (lambda c, x=o[1:]: c + x) for o in self.ops[2:])]
        for w in words:
            end = at + len(w)
            own = best[at:end]
            first = "".join([write[o](c) for c, o in zip(w, own)]) if any(own) else w
            yield first, [[(x, write[o](c)) for x, o in zip(gs, os) if x > -1e30] for c, gs, os in zip(w, g[at:end], top[at:end])]
            at = end


def align(noisy: str, true: str) -> list[str] | None:
    """Operations that turn ``noisy`` into ``true`` at least cost; None if a character would need more than one."""
    n, m = len(noisy), len(true)
    d = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        up, row, c = d[i - 1], d[i], noisy[i - 1]
        for j in range(1, m + 1):
            row[j] = min(up[j - 1] + (c != true[j - 1]), up[j] + 1, row[j - 1] + 1)
    ops, i, j, extra = [], n, m, ""
    while i:
        if j and d[i][j] == d[i - 1][j - 1] + (noisy[i - 1] != true[j - 1]):
            same = noisy[i - 1] == true[j - 1]
            ops.append(("+" + extra if extra else "") if same else "=" + true[j - 1] + extra)
            extra, i, j = "", i - 1, j - 1
        elif d[i][j] == d[i - 1][j] + 1:
            if extra:
                return None
            ops.append("-")
            i -= 1
        else:
            if extra:
                return None
            extra, j = true[j - 1], j - 1
    ops = ops[::-1]
    if j:  # what precedes the first character belongs to it
        if j > 1 or not ops or ops[0][:1] in ("-", "+"):
            return None
        ops[0] = "=" + true[0] + (ops[0][1:] or noisy[0])
    for k in range(1, n):  # a letter read for two: both belong to it
        if ops[k - 1][:1] == "+" and ops[k][:1] == "=" and len(ops[k]) == 2:
            ops[k - 1], ops[k] = "", "=" + ops[k - 1][1:] + ops[k][1:]
    return ops


def _drops(w: str, depth: int) -> set[str]:
    out = level = {w}
    for _ in range(depth):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        out = out | level
    return out


def examples_from(unknown: Counter, capitalised: Counter, known: dict[str, int], most: int = EXAMPLES) -> list[tuple[str, list[str]]]:
    """Training examples: unknown words in lower case that lie one or two edits from a known word, by edits that
    recur; known words and names, kept; known words torn by a blank or a line end, joined; neighbours, not joined."""
    index: dict[str, list[str]] = {}
    for w in known:
        if 3 <= len(w) <= 20:
            for x in _drops(w, 2):
                index.setdefault(x, []).append(w)
    pairs, names = [], []
    ranked = lambda c: sorted(c.items(), key=lambda x: (-x[1], x[0]))
    for u, n in [*ranked(unknown), *((u, 0) for u, _ in ranked(capitalised))]:
        near = {w for x in _drops(u, (2 if len(u) > 5 else 1) if n else 0) for w in index.get(x, ())} if len(u) <= 20 else set()
        ops = [(sum(o != "" for o in a), -known[w], w, a) for w in near if abs(len(u) - len(w)) < 3 and (a := align(u, w)) is not None]
        ops = [x for x in ops if x[0] <= (2 if len(u) > 5 else 1)]
        if ops:
            pairs.append((u, min(ops)[3], n))
        elif not n:
            names.append(u)
    edit = Counter((c, o) for u, a, n in pairs if n for c, o in zip(u, a) if o)
    often = max(3, EDIT_PART * sum(edit.values()))
    good = [(u, a) for u, a, n in pairs if n and all(edit[c, o] >= (often if (c + o[-1]).isascii() else 3) for c, o in zip(u, a) if o)]
    rng = np.random.default_rng(11)
    words = sorted(known, key=lambda w: (-known[w], w))[: most // 3]
    kept = [(w, [""] * len(w)) for w in words + names[: most // 4]]
    torn = []
    for w in words[: most // 8]:
        if len(w) > 4:
            i = int(rng.integers(2, len(w) - 1))
            for sep in (" ", "-\n"):
                torn.append((w[:i] + sep + w[i:], [""] * i + ["-"] * len(sep) + [""] * (len(w) - i)))
    beside = [(a, b) for a, b in zip(words[: most // 8], reversed(words[: most // 8])) if a + b not in known]
    apart = [(a + sep + b, [""] * (len(a) + len(b) + len(sep))) for a, b in beside for sep in (" ", "-\n")]
    return good[: most // 2] + kept + torn + apart


# ---------------------------------------------------------------- reading an item


def page_number(line: str, set_off: bool = False) -> bool:
    """Whether the line holds only a page number. Where it is ``set_off``, what looks like a table row may be one in a frame."""
    s = line.strip()
    if not s or len(s) > 24 or (TABLE_ROW.fullmatch(s) and not set_off):
        return False
    bare = s.strip("-–—·•[]()|.* ").lower()
    if ROMAN.fullmatch(bare) and bare:
        return True
    m = NUMBER_LINE.fullmatch(s)
    if not m or any(g and sum(map(str.isdigit, g)) < max(1, len(g) - 1) for g in (m[2], m[3])):  # at most one misread digit
        return False
    word = (m[1] or "").lower()
    return not word or any(word == p or (len(p) > 3 and len(p) == len(word) and sum(a != b for a, b in zip(p, word)) == 1) for p in PAGE_WORDS)


def number_lines(lines: list[str], is_page: bool) -> list[int]:
    """Lines that hold only a page number: on pages among the first or last lines; elsewhere not beside table rows."""
    short = [i for i, x in enumerate(lines) if 0 < len(x if len(x) < 25 else x.strip()) < 25 and not x.isspace()]
    if not short:
        return []
    visible = [i for i, x in enumerate(lines) if x and not x.isspace()]
    rank = {i: min(k, len(visible) - 1 - k) for k, i in enumerate(visible)}
    out = []
    for i in short:
        alone = is_page and rank[i] == 0 and not any(TABLE_ROW.fullmatch(lines[j]) for j in (i - 1, i + 1) if 0 <= j < len(lines))
        if page_number(lines[i], alone) and (not is_page or rank[i] < EDGE):
            beside = [lines[j] for j in (i - 1, i + 1) if 0 <= j < len(lines) and lines[j].strip()]
            table = any(TABLE_ROW.fullmatch(x) or (SHORT_ROW.fullmatch(x) and not page_number(x)) for x in beside)
            if not (table and SHORT_ROW.fullmatch(lines[i])):
                out.append(i)
    return out


def line_words(s: str) -> list[str]:
    """The words of a line without its digits, the commonest misreadings undone."""
    s = (s if s.isascii() else unicodedata.normalize("NFC", s)).lower()
    s = INSIDE.sub("", s.translate(SHAPES_OF_SIGNS) if "@" in s else s)
    return [w if w.isalpha() else w.translate(SHAPES_OF_DIGITS) for w in WORD.findall(s) if not w.isdigit()]


def line_form(line: str, set_off: int = 0) -> list[str]:
    """The words of a line that can be a running line, without digits; empty where it cannot. ``set_off``: 0 among other lines, 1 between
    blank lines, page numbers or the ends of an item, 2 so at the edge of a page, where every length and ending will do."""
    s = line.strip()
    if not s or s.startswith(("#", "|", "- [", "* ")) or (set_off < 2 and not 6 <= len(s) <= 90):
        return []
    if set_off < 2 and (s[-1] in ".!?:;," and (set_off or not s[-2:-1].isdigit()) or not set_off and (s[-1] == ")" and not s[-2:-1].isdigit() or sum(map(str.isalpha, s.split())) > 9)):
        return []
    if TABLE_ROW.fullmatch(s):
        return []
    words = line_words(NUMBER_AT_END.sub("", s) if "  " in s or "\t" in s else s)
    if set_off:
        return words if (set_off == 2 or len(words) <= 12) and any(len(w) > 2 for w in words) else []
    return words if 2 <= len(words) <= 9 else []


def candidates(lines: list[str], numbers: list[int], is_page: bool) -> list[tuple[int, list[str], str]]:
    """By place and form: (line, words, surroundings) of the lines that can be running lines. Surroundings are the nearest lines that are
    neither that nor page numbers, so the second line of a header does not stand for the text below it."""
    seen, marks, found = [i for i, x in enumerate(lines) if x and not x.isspace()], set(numbers), {}
    end = len(seen)
    places = range(end) if not is_page else sorted({*range(min(EDGE, end)), *range(max(0, end - EDGE), end)})
    opens = lambda n: not n or n == end or seen[n - 1] < seen[n] - 1 or seen[n] in marks or seen[n - 1] in marks
    # The rows of a page's header and footer stand together, apart from the text.
    top, foot = (next((n for n in range(1, min(EDGE, end) + 1) if opens(n)), 0), next((n for n in range(end - 1, max(0, end - EDGE) - 1, -1) if opens(n)), end)) if is_page else (0, end)
    for n in places:
        if seen[n] not in marks:
            words = line_form(lines[seen[n]], 2 if n < top or n >= foot else 1 if opens(n) and opens(n + 1) else 0)
            if words:
                found[n] = words
    out = []
    for n, words in found.items():
        a, b = n - 1, n + 1
        while a >= 0 and (a in found or seen[a] in marks):
            a -= 1
        while b < len(seen) and (b in found or seen[b] in marks):
            b += 1
        out.append((seen[n], words, (lines[seen[a]] if a >= 0 else "") + "\n" + (lines[seen[b]] if b < len(seen) else "")))
    return out


class _Words(dict):
    def __missing__(self, w: str) -> int:
        h = self[w] = digest(w)
        return h


def digest(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


_HASHES, _POWERS, _WHOLE = _Words(), [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 4096)], (1 << 64) - 1


def signatures(words: list[str]) -> list[int]:
    """Hashes of the line without blanks, of the line, and of the line without each of its words, so one misread or torn word
    does not hide it; of more than twelve words, of its halves."""
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    joined, words = digest("".join(words)), words[: len(_POWERS)]
    if len(words) > 12:
        half = len(words) // 2
        sums = [joined, digest(" ".join(words[:half])) ^ 1, digest(" ".join(words[half:])) ^ 2]
    else:
        terms = [_HASHES[w] * p for w, p in zip(words, _POWERS)]
        total = sum(terms)
        sums = [joined, total, *(total - t + p for t, p in zip(terms, _POWERS))] if len(words) > 2 else [joined, total]
    return [x - (1 << 64) if (x := v & _WHOLE) >> 63 else x for v in sums]


class Reader:
    """What one worker knows: vocabulary, editor, and the words it has judged."""

    def __init__(self, known: dict[str, int], editor: Editor | None, trigrams: frozenset[str] = frozenset()):
        self.known, self.editor, self.trigrams = known, editor, trigrams
        self.memo: dict[str, str] = {}
        self.divisions: dict[tuple[str, str], bool] = {}
        self.raw = _Raw(known)

    def divided(self, a: str, mark: str, b: str, rest: str) -> bool:
        """Whether the mark at a line end between ``a`` and ``b`` (with ``rest`` up to the next white space) divides a word; else it is the hyphen of a compound."""
        if mark not in "-‐":
            return True
        known = self.known
        if a + b in known:
            return True
        if f"{a}-{b}" in known or (a in known and b in known) or (a in known and rest.startswith(("-", "‐"))):
            return False
        if not self.editor:
            return True
        if (a, b) not in self.divisions:
            if len(self.divisions) > 200_000:
                self.divisions.clear()
            self.divisions[a, b] = self.editor.join_gain(a, "-\n", b) >= BREAK_GAIN
        return self.divisions[a, b]

    def joined(self, text: str) -> tuple[str, bool]:
        """The text with the words that a line end divides put together, the line breaking after the word; and whether there was any.
        Compounds get their line break after them too."""
        any_ = False

        def put(m: re.Match) -> str:
            nonlocal any_
            at, b = m.start(), LETTERS.match(m[1])[0]
            a = LAST_LETTERS.search(text, max(0, at - 64), at)[0]
            if self.divided(a.lower(), text[at], b.lower(), m[1][len(b) :]):
                any_ = True
                return m[1] + "\n"
            return text[at] + m[1] + "\n"

        return BREAK.sub(put, text), any_

    def correct(self, words: set[str]) -> None:
        """Judge lower-cased words: the known word that each stands for, or "". In front of a capitalised word, which may be a name,
        stands ^: of it only operations preferred to keeping count. Two parts with a blank between are joined if the editor deletes the blank."""
        if len(self.memo) > 1_000_000:
            self.memo.clear()
        new = sorted(w for w in words if w not in self.memo)
        if not self.editor:
            self.memo.update(dict.fromkeys(new, ""))
            return
        torn, new = [w for w in new if " " in w], [w for w in new if " " not in w]
        for lo in range(0, len(torn), 8192):
            part = torn[lo : lo + 8192]
            s, at = self.editor.scores(part), 0
            for w in part:
                blank = s[at + w.index(" ")]
                self.memo[w] = w.replace(" ", "") if blank[1] - blank[0] >= JOIN_GAIN else ""
                at += len(w)
        for lo in range(0, len(new), 8192):
            part = new[lo : lo + 8192]
            for w, (first, ways) in zip(part, self.editor.proposals([w.lstrip("^") for w in part])):
                self.memo[w] = self._judge(w, first, ways)

    def _judge(self, w: str, first: str, ways: list[list[tuple[float, str]]]) -> str:
        known, name = self.known, w[0] == "^"
        w = w.lstrip("^")
        if first != w and first in known:
            return first
        least, best = NAME_GAIN if name else -np.inf, ""
        # A name is known by its letters: one with a sequence that no trusted word has, and a reading without, is misread.
        odd = self.trigrams and len(w) > 3 and w.isalpha() and not self.plausible(w)
        spelt = ""
        for i, here in enumerate(ways):
            for g, x in here:
                if g > least and (x or not w[i].isalpha()):
                    r = w[:i] + x + w[i + 1 :]
                    if r in known:
                        least, best = g, r
                    elif odd and not spelt and self.plausible(r):
                        spelt = r
        if not best:  # one letter read as two: one of them goes, the other changes
            for i in range(len(w) - 1):
                for g, x in ways[i]:
                    for h, y in ways[i + 1]:
                        if g + h > least and bool(x) != bool(y):
                            r = w[:i] + x + y + w[i + 2 :]
                            if r in known:
                                least, best = g + h, r
                            elif odd and not spelt and self.plausible(r):
                                spelt = r
        if not best and not spelt and self.trigrams and len(w) > 3 and SIGN_INSIDE.fullmatch(w):
            r = INSIDE.sub("", w.translate(SHAPES_OF_SIGNS))
            spelt = r if self.plausible(r) else ""
        return best or spelt or (first if DIGIT_INSIDE.fullmatch(w) else "")

    def plausible(self, w: str) -> bool:
        w, t = f"^{w}$", self.trigrams
        return all([w[i : i + 3] in t for i in range(len(w) - 2)])

    def tokens(self, text: str) -> list[tuple[int, int, str]]:
        """Begin, end and lower-cased form (after ^ if capitalised) of each token of the running text that the vocabulary does not
        know, and, with a blank between, of pairs of neighbours that are one torn word. A line without any known word is no
        running text. What lies between two blanks is judged once; most lines hold nothing to look at."""
        out, at, raw, names, known = [], 0, self.raw, None, self.known
        if len(raw) > 1_000_000:
            raw.clear()
        get = raw.__getitem__
        for line in text.split("\n"):
            parts = line.split(" ")
            codes = list(map(get, parts))
            if any(codes) and (None in codes or any([c[0] for c in codes if c])) and not TABLE_ROW.fullmatch(line):
                pos, here = at, 0
                for i in [i for i, c in enumerate(codes) if c]:
                    pos, here, part, entries = pos + sum(map(len, parts[here:i])) + i - here, i, parts[i], codes[i][1]
                    last = len(entries) - 1
                    for j, (b, e, w, letters) in enumerate(entries):
                        if letters:
                            if i and not j and not b and (p := self._part(parts[i - 1], codes[i - 1], False)) and p + w in known:
                                out.append((pos - 1 - len(p), pos + e, p + " " + w))
                            if j == last and e == len(part) and i + 1 < len(parts) and not (codes[i + 1] and codes[i + 1][1][0][3]):
                                if (p := self._part(parts[i + 1], codes[i + 1], True)) and w + p in known:
                                    out.append((pos + b, pos + e + 1 + len(p), w + " " + p))
                            if e - b < 3:
                                continue
                        if part[b].isupper():
                            if letters and text.count(part[b:e]) > 1:  # a capitalised word that recurs in an item as it is, is a name
                                names = names or Counter(NAME.findall(text))
                                if names[part[b:e]] > 1:
                                    continue
                            w = "^" + w
                        out.append((pos + b, pos + e, w))
            at += len(line) + 1
        return out

    def _part(self, part: str, code, begins: bool) -> str | None:
        """The word with which what lies between two blanks begins, or ends, if it is of letters only and nothing divides it from the blank."""
        if code:
            b, e, w, letters = code[1][0 if begins else -1]
            return w if letters and (not b if begins else e == len(part)) else None
        w = part.lower()
        if w not in self.known:
            w = TRAIL.sub("", w) if begins else OPENING.sub("", w)
        return w if w in self.known else None


class _Raw(dict):
    """What lies between two blanks: None if it holds known words only, False if nothing of running text, else whether a known word is in it and
    its other tokens (begin, end, lower case, whether of letters only)."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, raw: str):
        known, sure, out = self.known, False, []
        for m in TOKEN.finditer(raw):
            t, b = TRAIL.sub("", m[1]), m.start(1)
            w = t.lower()
            if w in known:
                sure = True
            elif t.isalpha():
                out.append((b, b + len(t), w, True))
            else:
                head, _, tail = w.partition("'") if "'" in w else w.partition("’")
                if tail and head + tail not in known:  # an elided article is a word of its own
                    if head in known:
                        b, w, t = b + len(head) + 1, tail, t[len(head) + 1 :]
                    elif tail in known:
                        w, t = head, t[: len(head)]
                if 3 <= len(t) < 30 and sum(map(str.isalpha, t)) >= 2 and not HASHLIKE.fullmatch(t) and not all(p in known for p in PARTS.split(w)):
                    out.append((b, b + len(t), w, False))
        self[raw] = code = (sure, out) if out else (None if sure else False)
        return code


def _reader(known: dict[str, int], grams: frozenset[str], editor: tuple | None) -> Reader:
    return Reader(known, Editor(*editor) if editor else None, grams)


def repaired(reader: Reader, text: str, drop: set[int]) -> str:
    """The text without the lines of ``drop``, with corrected and joined words, each paragraph on one line."""
    rows = [x for i, x in enumerate(text.split("\n")) if i not in drop]
    text = reader.joined("\n".join(rows))[0]
    found = reader.tokens(text)
    reader.correct({w for _, _, w in found})
    out, at = [], 0
    for a, b, w in sorted(found, key=lambda x: (x[0], -x[1])):
        right = reader.memo[w]
        if a >= at and right and (right in reader.known or (right.isalpha() and reader.plausible(right))):
            old = text[a:b]
            out += [text[at:a], right.upper() if old.isupper() and len(old) > 1 else right[:1].upper() + right[1:] if old[0].isupper() else right]
            at = b
    text = "".join(out) + text[at:]
    blocks = []
    for part in re.split(r"\n[^\S\n]*\n\s*", text.strip()):
        block: list[str] = []
        for line in part.split("\n"):
            flows = block and not TABLE_ROW.fullmatch(line) and not TABLE_ROW.fullmatch(block[-1]) and not re.match(r"\s*([-*#|•·]|\d+[.)])\s", line) and not block[-1].startswith("#")
            if flows:
                block[-1] = block[-1].rstrip() + " " + line.strip()
            else:
                block.append(line.rstrip())
        blocks.append("\n".join(block))
    return "\n\n".join(b for b in blocks if b.strip())


def _repairing(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(*shared.value)
        for b in batches:
            out = []
            for kind, text, lines in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                out.append(text if not text or not text.strip() else repaired(reader, text, {*lines, *number_lines(text.split("\n"), kind == "page")}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["item_kind", "item_id", "text"])

    return run


def _scan(shared, judge: bool = True):
    """item_kind, item_id, key, damage (other than running lines; empty unless ``judge``), and the signatures of the lines that can be running lines: their
    line and, at one of equal signatures of an item, the least and greatest hash of the surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(*shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                p = b.slice(lo, 1000)
                pages, texts = [k == "page" for k in p.column(0).to_pylist()], [t or "" for t in p.column(3).to_pylist()]
                rows = [t.split("\n") for t in texts]
                numbers = [number_lines(r, k) for r, k in zip(rows, pages)]
                lines = [candidates(r, n, k) for r, n, k in zip(rows, numbers, pages)]
                whole = [reader.joined(t) for t in texts] if judge else []
                found = [reader.tokens(t) for t, _ in whole]
                reader.correct({w for f in found for _, _, w in f} | {"^" + w for c in lines for _, ws, _ in c for w in ws if len(w) > 2 and w not in reader.known})
                damage = [[d for d, has in (("broken_word", j), ("misread", misread_count(reader, f) >= MISREADS), ("page_number", n)) if has] for (_, j), f, n in zip(whole, found, numbers)] if judge else [[]] * len(texts)
                flat, ends = [], [0]
                for c in lines:
                    seen: dict[int, list] = {}
                    for i, words, near in c:
                        ctx = digest(near) >> 33
                        for s in signatures([reader.memo.get("^" + w) or w for w in words]):
                            if s in seen:
                                seen[s][2:] = [min(seen[s][2], ctx), max(seen[s][3], ctx)]
                                if seen[s][1] != i:
                                    flat.append((s, i, None, None))
                            else:
                                seen[s] = [s, i, ctx, ctx]
                    flat += map(tuple, seen.values())
                    ends.append(len(flat))
                cols = list(zip(*flat)) if flat else [()] * 4
                sigs = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["sig", "line", "lo", "hi"])
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), p.column(2), pa.array(damage, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sigs)], names=["item_kind", "item_id", "key", "damage", "lines"])

    return run


_SCANNED = "item_kind string, item_id long, key string, damage array<string>, lines array<struct<sig:long,line:int,lo:int,hi:int>>"


def misread_count(reader: Reader, found: list[tuple[int, int, str]]) -> int:
    """Misread words; a torn word and its parts count once."""
    n, reach = 0, -1
    for a, b, w in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= reach and reader.memo[w]:
            n, reach = n + 1, b
    return n


def vocabulary(trusted: DataFrame) -> tuple[dict[str, int], frozenset[str]]:
    """Known words and their counts, from all trusted texts (key, text): words written in lower case in at least
    KNOWN_PART of all originals, and capitalised ones (nouns of some languages) in KNOWN_SPREAD of them, as names are not.
    An original of m different words adds m to the sum of these parts, so at most m / KNOWN_PART words, some ten thousands, reach the driver. Also the sequences of
    three letters in at least GRAM_PART of all different words (no more than the alphabet allows)."""
    token = F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{Nd}_./\\@#`-])\p{L}+(?:-\p{L}+)*(?![\p{L}\p{Nd}_/\\@]|[.][a-z]|\()"), F.lit(0))
    # Of a compound, itself and its first part count.
    token = F.flatten(F.transform(token, lambda t: F.when(F.instr(t, "-") > 0, F.array(t, F.substring_index(t, "-", 1))).otherwise(F.array(t))))
    rows = spread(trusted.where("text IS NOT NULL")).select(F.xxhash64("key").alias("key"), F.explode(token).alias("w"))
    plain = (F.length("w") > 1) & (F.substring("w", 2, 64) == F.lower(F.substring("w", 2, 64)))
    rows = rows.select("key", F.lower("w").alias("lw"), (F.col("w") == F.lower("w")).cast("int").alias("low"), plain.cast("int").alias("noun"))
    per = rows.groupBy("lw", "key").agg(F.count("*").alias("n"), F.max("low").alias("low"), F.max("noun").alias("noun"))
    words = per.groupBy("lw").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("noun").alias("noun"))
    words = checkpointed(words)
    gram = F.transform(F.sequence(F.lit(1), F.length("lw")), lambda i: F.concat(F.lit("^"), F.col("lw"), F.lit("$")).substr(i, F.lit(3)))
    grams = words.select(F.explode(F.array_distinct(gram)).alias("g")).groupBy("g").count().where(F.col("count") >= max(KNOWN_COUNT, GRAM_PART * words.count()))
    originals = trusted.agg(F.approx_count_distinct("key", 0.02)).first()[0] or 0
    known = words.where((F.col("low") >= max(KNOWN_COUNT, KNOWN_PART * originals)) | (F.col("noun") >= max(KNOWN_COUNT, KNOWN_SPREAD * originals)))
    words_ = {r.lw: r.n for r in known.select("lw", "n").collect()}
    return {bare(w): n for w, n in words_.items()} | words_, frozenset(r.g for r in grams.collect())  # whole texts written without accents are no scan damage


def train(items: DataFrame, known: dict[str, int]) -> Editor | None:
    """An editor from a sample of SAMPLE_ITEMS items (by a hash of their ids)."""
    if not known:
        return None
    some = items.where("text IS NOT NULL")
    rows = sample_by_hash(some, items.count(), SAMPLE_ITEMS, "item_kind", "item_id").select("text").collect()
    r, unknown, capitalised = Reader(known, None), Counter(), Counter()
    for row in rows:
        for w in {w for _, _, w in r.tokens(r.joined(row.text)[0]) if " " not in w}:
            if w[0] != "^":
                unknown[w] += 1
            elif w[1:].isalpha():
                capitalised[w[1:]] += 1
    return Editor.train(examples_from(Counter(dict(unknown.most_common(EXAMPLES))), Counter(dict(capitalised.most_common(EXAMPLES))), known))


def _models(items: DataFrame, trusted: DataFrame):
    known, grams = vocabulary(trusted)
    editor = train(items, known)
    return items.sparkSession.sparkContext.broadcast((known, grams, (editor.ops, editor.w.astype(np.float16), {c: o.tolist() for c, o in editor.seen.items()}) if editor else None))


def running(scanned: DataFrame) -> DataFrame:
    """item_kind, item_id, line: running lines, that is lines whose form recurs in RECURS items of the same original, in
    at least two different surroundings (a passage indexed twice is no running line). A signature travels as one hash of itself and the original."""
    l = scanned.where("key IS NOT NULL").select("item_kind", "item_id", "key", F.explode("lines").alias("l"))  # noqa: E741
    l = l.select(F.xxhash64("item_kind", "key", "l.sig").alias("h"), (F.col("item_kind") == "page").alias("page"), "item_id", "l.line", "l.lo", "l.hi")  # noqa: E741
    often = l.groupBy("h").agg(F.count("lo").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(f"n >= {RECURS} AND lo <> hi").select("h")
    hits = l.select("h", "page", "item_id", "line").join(often, "h", "left_semi")
    return hits.select(F.when(F.col("page"), F.lit("page")).otherwise(F.lit("chunk")).alias("item_kind"), "item_id", "line")


def _once(items: DataFrame) -> DataFrame:
    return spread(items.select("item_kind", "item_id", "key", "text"))


def damage(items: DataFrame, trusted: DataFrame) -> DataFrame:
    """From items (item_kind, item_id, key, text), one row each, and trusted texts (key, text): item_kind, item_id, defect."""
    items = _once(items)
    scanned = checkpointed(items.mapInArrow(_scan(_models(items, trusted)), _SCANNED))
    single = scanned.select("item_kind", "item_id", F.explode("damage").alias("defect"))
    lines = running(scanned).select("item_kind", "item_id", F.lit("running_line").alias("defect"))
    return single.unionByName(lines).distinct()


def repair(items: DataFrame, trusted: DataFrame) -> DataFrame:
    """item_kind, item_id, text: the repaired text of every item."""
    items = _once(items)
    shared = _models(items, trusted)
    scanned = checkpointed(items.mapInArrow(_scan(shared, judge=False), _SCANNED))
    lines = running(scanned).groupBy("item_kind", "item_id").agg(F.collect_set("line").alias("drop"))
    both = items.join(lines, ["item_kind", "item_id"], "left").select("item_kind", "item_id", "text", F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
    return both.mapInArrow(_repairing(shared), "item_kind string, item_id long, text string")
