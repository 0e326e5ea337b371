"""Problem 9: one form for texts that look the same on the page.

Method: look-alike characters are mapped in SQL (translate, replace), the mapped values are grouped under the Unicode
collation, which tells accents and case apart but not composed from decomposed accents, and each class gets its member with the least
id as canonical member, which is joined back. The collation also passes over a few signs it gives no weight, so an exact check
(composition in Python) divides its groups.

A text enters the collation only if another text has the same coarse hash: that of its mapped letters without marks, which equal
forms have in common. All joins but two go by hashes of 128 bits (of a text) and ids; whole texts move once to be grouped and once to be
written out, and no task gathers the texts or ids of a class. Exact copies are one row after partial aggregation.

Defined results: null texts and texts that print nothing get a null class and no canonical form; an exact copy shares
the class of its original; letter case, accents, raised and lowered digits, weight and slant of mathematical letters, and the kind and
number of visible white space and line breaks are differences; an id given with several texts takes part with each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxlake.runtime import checkpointed, spread

#: Code points that have characters; the rest stand for themselves.
POINTS = [*range(0x32400), *range(0xE0000, 0xE1000)]
#: Letters of other scripts with the shape of a Latin one (fixed values).
CYRILLIC = ("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝӏҮԌӀ", "ABESIJKMHOPCTYXaeopcyxsijhdqwlYGI")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳϹͿ", "ABEZHIKMNOPTYXocjCJ")
ARMENIAN = ("ՕՍոսօհյ", "OUnuohj")
CHEROKEE = ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZ4WVSLCPKB")
LISU = ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")
#: Of the mathematical alphabets, those that differ from ordinary letters neither in weight nor in slant.
PLAIN_MATH = ("MATHEMATICAL SANS-SERIF CAPITAL ", "MATHEMATICAL SANS-SERIF SMALL ", "MATHEMATICAL SANS-SERIF DIGIT ", "MATHEMATICAL MONOSPACE ")
#: Breaking and non-breaking hyphens, spaces of letter width that do not break.
SIGNS = ("‐‑   　", "--    ")
#: Characters that print nothing, besides those of the Unicode categories Cf and Cc.
BLANKS = "͏ᅟᅠ឴឵ㅤﾠ"
VISIBLE_CONTROLS = "\t\n\r\x0b\x0c\x85"


@lru_cache(maxsize=1)
def mapping() -> tuple[str, str, str, tuple[tuple[str, str], ...]]:
    """Characters with one substitute, those substitutes, characters to delete, and joined letters with their parts;
    from the rules of Unicode's compatibility forms, besides the short lists above. A letter composed of a listed one and
    marks becomes the substitute with the same marks, as its decomposed form does; where these have no single code point, it
    counts as joined."""
    one, joined, gone = {}, {}, list(BLANKS)
    for table in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, SIGNS):
        one.update(zip(*table))
    letters = dict(one)
    for c in map(chr, POINTS):
        kind = unicodedata.category(c)
        if kind == "Cf" or (kind == "Cc" and c not in VISIBLE_CONTROLS) or 0xFE00 <= ord(c) <= 0xFE0F or 0x180B <= ord(c) <= 0x180F or 0xE0100 <= ord(c) <= 0xE01EF:
            gone.append(c)
            continue
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and apart[0] in letters:
            to = unicodedata.normalize("NFC", letters[apart[0]] + apart[1:])
            one.update({c: to}) if len(to) == 1 else joined.update({c: to})
            continue
        tag, _, rest = unicodedata.decomposition(c).partition(" ")
        if tag in ("<wide>", "<narrow>") and c not in BLANKS:
            to = "".join(one.get(x, x) for x in unicodedata.normalize("NFKC", c))
            one.setdefault(c, to) if len(to) == 1 else joined.setdefault(c, to)
        elif tag == "<font>" and unicodedata.name(c, "").startswith(PLAIN_MATH):
            one.setdefault(c, unicodedata.normalize("NFKC", c))
        elif tag == "<compat>" and kind[0] == "L" and " " in rest:
            joined[c] = unicodedata.normalize("NFKC", c)
    return "".join(one), "".join(one.values()), "".join(dict.fromkeys(gone)), tuple(joined.items())


def spelt_letters() -> list[tuple[str, str]]:
    """Joined letters and letters with marks that are spelt out."""
    return [(a, b) for a, b in mapping()[3] if unicodedata.normalize("NFD", a) != a or len(b) <= 3 and unicodedata.name(a, "").startswith(("LATIN", "ARMENIAN", "HEBREW"))]


@lru_cache(maxsize=1)
def coarse_table() -> tuple[np.ndarray, dict[int, str]]:
    """What each character counts as in the coarse hash: a code point, GONE, MARK, or SEVERAL, which the second table spells."""
    src, dst, gone, joined = mapping()
    to = dict(zip(src, dst)) | dict.fromkeys(gone, "") | dict(joined)
    table, several = np.arange(sys.maxunicode + 1, dtype=np.int32), {}
    for i in POINTS:
        c = chr(i)
        x = to.get(c, c)
        y = "".join(z for z in unicodedata.normalize("NFD", x) if unicodedata.category(z)[0] != "M")
        if y != c:
            table[i] = GONE if not x else MARK if not y else ord(y) if len(y) == 1 else SEVERAL
            if len(y) > 1:
                several[i] = y
    return table, several


GONE, MARK, SEVERAL = -1, -2, -3
_SPACES = np.array([i for i in range(0x3001) if chr(i).isspace()], np.int32)


def coarse_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each text's mapped letters without marks, and whether the text prints anything."""
    table, several = coarse_table()
    m = table[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([0, *map(len, texts)])
    kept, ink = np.concatenate([[0], np.cumsum(m >= 0)]), np.concatenate([[0], np.cumsum((m != GONE) & ~np.isin(m, _SPACES))])
    odd = np.concatenate([[0], np.cumsum(m == SEVERAL)])
    flat, at = m[m >= 0].tobytes(), kept[ends] * 4
    out = np.empty(len(texts), np.int64)
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        part = flat[lo:hi]
        if odd[ends[i + 1]] > odd[ends[i]]:
            seq = ([table[ord(c)]] if ord(c) not in several else map(ord, several[ord(c)]) for c in texts[i])
            part = np.array([x for xs in seq for x in xs if x >= 0], np.int32).tobytes()
        out[i] = int.from_bytes(blake2b(part, digest_size=8).digest(), "little", signed=True)
    return out, ink[ends[1:]] > ink[ends[:-1]]


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            p = b.slice(lo, 1000)
            h, prints = coarse_hashes(p.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), p.column(2), pa.array(h)], names=["id", "h1", "h2", "coarse"]).filter(pa.array(prints))


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact check's key: two hashes of the composed form of the last column, which passes through."""
    for b in batches:
        d = [blake2b(unicodedata.normalize("NFC", s).encode("utf-8", "surrogatepass"), digest_size=16).digest() for s in b.column(b.num_columns - 1).to_pylist()]
        e = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(e[:, 0]), pa.array(e[:, 1])], names=[*b.schema.names, "e1", "e2"])


def skeleton(c: Column) -> Column:
    """The mapped text, all in the JVM. Deleting is what translate does with characters beyond the substitutes. Joined
    letters of two parts, and letters with marks, are spelt through one pass each, and only in texts that hold any."""
    src, dst, gone, _ = mapping()
    out, parts = F.translate(c, src + gone, dst), spelt_letters()
    spelt = out
    for a, b in parts:
        spelt = F.replace(spelt, F.lit(a), F.lit(b))
    return F.when(out.rlike(f"[{''.join(a for a, _ in parts)}]"), spelt).otherwise(out)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t, and two hashes that stand for the text."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.select("id", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), "t")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """rows (id, h1, h2, coarse) of all texts that print something, and a row for each different text of the classes of at least two:
    h1, h2, text_id (least id with this text), class_id (least id of the class), e1, e2 (hashes of the form its members share)."""
    rows = _rows(df, id_col, text_col).where(F.col("t").isNotNull() & F.col("id").isNotNull())
    prints = checkpointed(spread(rows).mapInArrow(_coarse, "id long, h1 long, h2 long, coarse long"))
    near = prints.groupBy("coarse").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("h2").alias("c"), F.max("h2").alias("d")).where("a <> b OR c <> d").select("coarse")
    texts = prints.join(near, "coarse", "left_semi").groupBy("coarse", "h1", "h2").agg(F.min("id").alias("id"))
    s = rows.join(texts, ["id", "h1", "h2"]).select("coarse", "h1", "h2", F.col("id").alias("text_id"), skeleton(F.col("t")).alias("s"))
    s = s.mapInArrow(_composed, "coarse long, h1 long, h2 long, text_id long, s string, e1 long, e2 long")
    s = s.select("coarse", F.col("s").cast(T.StringType("UNICODE")).alias("k"), "h1", "h2", "text_id", "e1", "e2")
    found = s.groupBy("coarse", "k").agg(F.min("text_id").alias("group_id"))
    # From here ids and hashes only. Rows delivered twice are one text.
    s = s.join(found, ["coarse", "k"]).groupBy("h1", "h2").agg(F.min("text_id").alias("text_id"), F.min("group_id").alias("group_id"), F.min("e1").alias("e1"), F.min("e2").alias("e2"))
    s = checkpointed(s)
    several = s.groupBy("group_id", "e1", "e2").agg(F.min("text_id").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return prints, s.join(several, ["group_id", "e1", "e2"]).select("h1", "h2", "text_id", "class_id", "e1", "e2")


def unify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, canonical: the text of the class's member with the least id, for every row."""
    prints, cls = classes(df, id_col, text_col)
    rows, h = _rows(df, id_col, text_col), ["h1", "h2"]
    first = cls.where("text_id = class_id").select("class_id", "e1", "e2", F.col("text_id").alias("id"), *h)
    first = rows.join(first, ["id", *h]).groupBy("class_id", "e1", "e2").agg(F.first("t").alias("canonical"))
    changed = cls.where("text_id <> class_id").join(first, ["class_id", "e1", "e2"]).select(*h, "canonical")
    own = prints.groupBy(*h).agg(F.min("id").alias("own"))
    to = own.join(cls.select(*h, "class_id"), h, "left").join(changed, h, "left").select(*h, F.coalesce("class_id", "own").alias("class_id"), "canonical")
    return rows.join(to, h, "left").select(F.col("id").alias(id_col), "class_id", F.when(F.col("class_id").isNotNull(), F.coalesce("canonical", "t")).alias("canonical"))


def lookalike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b (a < b): all rows of one class with different code points. Pairs of texts come first, then the copies of either side, so
    the work is that of writing the pairs."""
    prints, cls = classes(df, id_col, text_col)
    cls = checkpointed(cls)
    side = lambda h1, h2: cls.select("class_id", "e1", "e2", F.col("h1").alias(h1), F.col("h2").alias(h2))
    links = side("a1", "a2").join(side("b1", "b2"), ["class_id", "e1", "e2"]).where("a1 < b1 OR (a1 = b1 AND a2 < b2)")
    copies = prints.join(cls.select("h1", "h2"), ["h1", "h2"], "left_semi")
    named = lambda i, h1, h2: copies.select(F.col("id").alias(i), F.col("h1").alias(h1), F.col("h2").alias(h2))
    both = links.join(named("ia", "a1", "a2"), ["a1", "a2"]).join(named("ib", "b1", "b2"), ["b1", "b2"]).where("ia <> ib")
    return both.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()
