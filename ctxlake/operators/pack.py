"""Packing a source tree: ignore rules, globs, routing of files, renderings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxlake.config import DEFAULT, EngineConfig
from ctxlake.functions.text import text_tokens, universal_newlines
from ctxlake.operators.sessions import suffix

#: Patterns left out by default (fixed values).
EXCLUDES = (".git/", ".venv/", "venv/", "__pycache__/", "*.pyc", "node_modules/", "dist/", "build/", "*.egg-info/", ".pytest_cache/")
#: Suffixes of files that are no text (fixed values).
BINARY = (".zip", ".tar", ".gz", ".exe", ".dll", ".so", ".dylib", ".bin", ".db", ".sqlite", ".sqlite3", ".mp4", ".mp3", ".mov", ".ico")
#: Skipped files that a listing shows.
SKIPPED_SHOWN = 20


def _class(pattern: str, i: int) -> tuple[str, int] | None:
    """The class of characters that begins with the bracket at ``i`` as a regex, and where it ends; None if the bracket stands for itself."""
    end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] in ("!", "^") else 2))
    if end < 0:
        return None
    inside = re.sub(r"([\\\[&~])", r"\\\1", pattern[i + 1 : end])
    return "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end


def glob_regex(glob: str) -> str:
    """A whole-path shell pattern: * and ? also cross slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (found := _class(glob, i)):
            out.append(found[0])
            i = found[1]
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def ignore_regex(pattern: str) -> tuple[bool, str] | None:
    """(keeps, regex) of one ignore rule; None for comments and blank lines. A rule without an inner slash holds at any depth, one with
    a slash at its end only for folders; * stays within a folder, ** does not."""
    p = pattern.rstrip()
    if not p or p.startswith("#"):
        return None
    keeps = p.startswith("!")
    p = p[1:] if keeps or p.startswith("\\") else p
    folder, rooted = p.endswith("/"), "/" in p.rstrip("/")
    p, out, i = p.strip("/"), [], 0
    while i < len(p):
        if p.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif p.startswith("**", i):
            out.append(".*")
            i += 2
        elif p[i] == "[" and (found := _class(p, i)):
            out.append("(?!/)" + found[0])
            i = found[1] + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out.append(re.escape(p[i + 1]))
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(p[i], re.escape(p[i])))
            i += 1
    return keeps, ("^" if rooted else "(?:^|.*/)") + "".join(out) + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column, patterns: tuple[str, ...]) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for rule in patterns:
        r = ignore_regex(rule)
        if r is not None:
            out = F.when(path.rlike(r[1]), F.lit(not r[0])).otherwise(out)
    return out


def selected(path: Column, include: str | None = None, exclude: str | None = None, patterns: tuple[str, ...] = EXCLUDES) -> Column:
    keep = ~ignored(path, patterns)
    if include:
        keep = keep & path.rlike(glob_regex(include))
    return keep & ~path.rlike(glob_regex(exclude)) if exclude else keep


def looks_like_text(content: Column) -> Column:
    """The first kilobyte is valid UTF-8."""
    return F.is_valid_utf8(F.substring(content, 1, 1024).cast("string"))


def route(path: Column, content: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return F.when(suffix(path).isin(*cfg.distillable), "distill").when(suffix(path).isin(*BINARY) | ~looks_like_text(content), "skip").otherwise("text")


def decode(content: Column) -> Column:
    return universal_newlines(F.make_valid_utf8(content.cast("string")))


def pack(files: DataFrame, include: str | None = None, exclude: str | None = None, patterns: tuple[str, ...] = EXCLUDES, cfg: EngineConfig = DEFAULT, distilled: DataFrame | None = None) -> DataFrame:
    """path, route (text, distill, skip), reason, text, tokens of the selected files (path, content). ``distilled`` holds the distillable ones (path, text, tokens, error):
    their text stands for the file, their error, or that they are not there, is the reason why a file is skipped."""
    f = files.where(selected(F.col("path"), include, exclude, patterns)).select("path", route(F.col("path"), F.col("content"), cfg).alias("route"), "content")
    f = f.select("path", "route", F.when(F.col("route") == "text", decode(F.col("content"))).alias("text"))
    if distilled is None:
        return f.select("path", "route", F.when(F.col("route") == "skip", "no text").alias("reason"), "text", text_tokens("text").alias("tokens"))
    # Only the names of the distillable files meet their results; texts stay where they are.
    d = f.where("route = 'distill'").select("path").join(distilled.select("path", F.col("text").alias("t"), F.col("tokens").cast("long").alias("tokens"), F.col("error").alias("e"), F.lit(True).alias("there")), "path", "left")
    bad = F.when(F.col("there").isNull(), "not distilled").when(F.col("e").isNotNull(), F.concat(F.lit("not distilled: "), F.col("e")))
    d = d.select("path", F.when(bad.isNull(), "distill").otherwise("skip").alias("route"), bad.alias("reason"), F.when(bad.isNull(), F.coalesce("t", F.lit(""))).alias("text"), F.when(bad.isNull(), F.coalesce("tokens", text_tokens("t"))).otherwise(0).alias("tokens"))
    own = f.where("route <> 'distill'").select("path", "route", F.when(F.col("route") == "skip", "no text").alias("reason"), "text", text_tokens("text").alias("tokens"))
    return own.unionByName(d)


def skipped(packed: DataFrame, shown: int = SKIPPED_SHOWN) -> DataFrame:
    """path, reason of the first ``shown`` files that were skipped, in the order of paths: a top-k."""
    return by_path(packed.where("route = 'skip'").select("path", "reason")).limit(shown)


def by_path(df: DataFrame) -> DataFrame:
    """Sorted by path components, so a/b comes before a-b."""
    return df.orderBy(F.split("path", "/"))


def markdown_section(path: Column, text: Column, distilled: Column) -> Column:
    return F.concat(F.lit("## "), path, F.when(distilled, F.lit(" (distilled)")).otherwise(F.lit("")), F.lit("\n\n```\n"), text, F.lit("\n```\n"))


def xml_section(path: Column, text: Column, distilled: Column) -> Column:
    """Quotes and the end of CDATA are escaped."""
    esc = F.replace(F.replace(F.replace(path, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    body = F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit('  <file path="'), esc, F.lit('"'), F.when(distilled, F.lit(' distilled="true"')).otherwise(F.lit("")), F.lit(">\n    <![CDATA["), body, F.lit("]]>\n  </file>"))


def head(packed: DataFrame) -> DataFrame:
    n = packed.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    return n.select(F.concat(F.lit("# Packed tree: "), F.col("n").cast("string"), F.lit(" files, about "), F.col("t").cast("string"), F.lit(" tokens\n")).alias("head"))


def document(packed: DataFrame, style: str = "markdown") -> DataFrame:
    """part (0 opening, 1 files, 2 closing), path, section: one document as rows in its order. A pack of any size is written that way (write_document) without any
    task holding all of it."""
    files = packed.where("route <> 'skip'")
    section = xml_section if style == "xml" else markdown_section
    rows = files.select(F.lit(1).alias("part"), "path", section(F.col("path"), F.coalesce("text", F.lit("")), F.col("route") == "distill").alias("section"))
    if style == "xml":
        ends = packed.sparkSession.createDataFrame([(0, "", "<packed_tree>"), (2, "", "</packed_tree>")], "part int, path string, section string")
    else:
        ends = head(files).select(F.lit(0).alias("part"), F.lit("").alias("path"), F.col("head").alias("section"))
    return rows.unionByName(ends).orderBy("part", F.split("path", "/"))


def write_document(packed: DataFrame, folder: str, style: str = "markdown") -> None:
    """The document as text files whose order by name is its order."""
    document(packed, style).select("section").write.mode("overwrite").text(folder)
