"""Text expressions (Column -> Column). White space, rounding and line breaks follow one set of rules in every operator:
white space is the Unicode class below, lengths count code points, halves round to the even neighbour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as the inside of a regex character class (fixed values).
WS = r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0  -     　"
#: Line ends: \r\n, \n, \r, vertical tab, form feed, file/group/record separators, NEL, U+2028, U+2029 (fixed values).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda's variable is bound, while a repeated expression is computed again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: str | Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(col(c), f"^[{WS}]+|[{WS}]+$", "")


def is_blank(c: str | Column) -> Column:
    return ~F.coalesce(col(c), F.lit("")).rlike(f"[^{WS}]")


def even_round(c: Column) -> Column:
    return F.bround(c)


def text_tokens(c: str | Column) -> Column:
    """Token estimate: 0 for null or empty, else max(1, code points / 4 rounded half to even)."""
    n = F.coalesce(F.length(col(c)), F.lit(0))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(n / F.lit(4.0)).cast("int"))).cast("long")


def split_lines(c: str | Column) -> Column:
    """Lines without their ends; no empty last line after a final line end; an empty text has no lines."""
    return let(F.split(col(c), LINE_END, -1), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a))


def collapse_space(c: str | Column) -> Column:
    """Runs of white space to one space, stripped, lower case: the form in which paragraphs are compared."""
    return F.lower(F.regexp_replace(F.regexp_replace(col(c), f"[{WS}]+", " "), "^ | $", ""))


def index_terms(c: str | Column) -> Column:
    """Search terms: runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def universal_newlines(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"\r\n?", "\n")


def cap(c: str | Column, n: int, mark: str = "...") -> Column:
    """The first n code points, and ``mark`` if there were more."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)
