"""Shorter command output: version-control status, test runs, install logs, everything else. All expressions work within a row on arrays of
lines; nothing is shuffled and no result is longer than its input. The patterns that tell the kinds apart are fixed values: they are the formats of the tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxlake.config import DEFAULT, EngineConfig
from ctxlake.functions.text import LINE_END, WS, is_blank, let, split_lines, strip

#: Meaning of a status code's first letter (fixed values).
CODES = {"M": "modified", "A": "added", "D": "deleted", "R": "renamed", "C": "copied", "U": "unmerged", "?": "untracked", "!": "ignored"}


def is_git_status(t: Column) -> Column:
    human = t.contains("On branch ") & t.rlike("(modified:|new file:|deleted:|Untracked files:|nothing to commit)")
    return t.rlike(rf"(?md)^\?\?[{WS}]|^[{WS}]?[MADRCU][{WS}]+[^{WS}]") | human


def is_pytest(t: Column) -> Column:
    return t.rlike("=+ (test session starts|FAILURES|short test summary)") | t.rlike(r"(?md)^\p{Nd}+ (passed|failed)")


def is_install_log(t: Column) -> Column:
    return t.rlike(r"(?md)^(Collecting|Downloading|Requirement already satisfied|added \p{Nd}+ packages)")


def kind(t: Column) -> Column:
    return F.when(is_git_status(t), "git-status").when(is_pytest(t), "pytest").when(is_install_log(t), "install").otherwise("generic")


def collapse_repeats(lines: Column) -> Column:
    """Runs of equal lines: the line, and a note of how often it repeats. Each line is laid beside the one before it, so the work is linear."""
    note = lambda n: F.concat(F.lit("    (same line, "), (n - 1).cast("string"), F.lit(" times more)"))
    none = F.array().cast("array<string>")

    def starts(a: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))
        marked = F.zip_with(a, before, lambda x, y: F.struct(x.alias("x"), (y.isNull() | (x != y)).alias("new")))
        return F.filter(F.transform(marked, lambda m, i: F.when(m["new"], F.struct(i.alias("i"), m["x"].alias("x")))), lambda r: r.isNotNull())

    def runs(s: Column, n: Column) -> Column:
        ends = F.concat(F.slice(F.transform(s, lambda r: r["i"]), F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.array(n))
        return F.flatten(F.zip_with(s, ends, lambda r, e: F.when(e - r["i"] > 1, F.array(r["x"], note(e - r["i"]))).otherwise(F.array(r["x"]))))

    return let(lines, lambda a: F.when(F.size(a) == 0, none).otherwise(let(starts(a), lambda s: runs(s, F.size(a)))))


def truncate(lines: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """First and last lines with a note between; unchanged if nothing would be hidden."""

    def cut(a: Column) -> Column:
        hidden = F.size(a) - cfg.max_lines - cfg.tail_lines
        note = F.array(F.concat(F.lit("    ("), hidden.cast("string"), F.lit(" lines left out)")))
        return F.when(hidden <= 0, a).otherwise(F.concat(F.slice(a, 1, cfg.max_lines), note, F.slice(a, -cfg.tail_lines, cfg.tail_lines)))

    return let(lines, cut)


def generic(t: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return F.array_join(truncate(collapse_repeats(split_lines(t)), cfg), "\n")


def git_entries(t: Column) -> Column:
    """ARRAY<STRUCT<label, path>> of the changed paths. The text is cut in front of each section header (a line with a colon at its end), so
    that every part knows its section from its own first line."""
    human = r"^(modified|new file|deleted|renamed|copied|both modified):[" + WS + r"]+(.+)$"
    code = r"^([MADRCU?!]{1,2})[" + WS + r"]+(.+)$"
    side = WS.replace(r"\n", "")
    header = rf"(?md)^(?=[{side}]*(?!\()(?!(?:modified|new file|deleted|renamed|copied|both modified):[{side}]+[^\n]*[^{WS}])[^{WS}][^\n]*(?<=:)[{side}]*$|[{side}]*:[{side}]*$)"
    label = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])

    def entry(raw: Column, section: Column) -> Column:
        s = strip(raw)
        word, first = F.regexp_extract(s, human, 1), F.substring(F.regexp_extract(s, code, 1), 1, 1)
        of_human = F.struct(F.when(word == "new file", F.lit("added")).when(word == "both modified", F.lit("unmerged")).otherwise(word).alias("label"), strip(F.regexp_extract(s, human, 2)).alias("path"))
        of_code = F.struct(F.element_at(label, first).alias("label"), strip(F.regexp_extract(s, code, 2)).alias("path"))
        bare = F.struct(section.alias("label"), s.alias("path"))
        skip = (s == "") | s.startswith("(")
        return F.when(skip, F.lit(None)).when(s.rlike(human), of_human).when(s.endswith(":"), F.lit(None)).when(s.rlike(code), of_code).when(raw.rlike("^[\t ]") & section.isNotNull(), bare)

    def part(p: Column) -> Column:
        first = strip(F.substring_index(p, "\n", 1))
        low = F.when(first.endswith(":") & ~first.startswith("(") & ~first.rlike(human), F.lower(first))
        section = F.when(low.contains("untracked"), F.lit("untracked")).when(low.contains("unmerged"), F.lit("unmerged"))
        return F.transform(F.split(p, "\n", -1), lambda raw: entry(raw, section))

    return F.filter(F.flatten(F.transform(F.split(F.regexp_replace(t, LINE_END, "\n"), header, -1), part)), lambda e: e.isNotNull())


def git_status(t: Column) -> Column:
    line = r"(?md)^(?:On branch |## )([^" + WS + r"]+)"
    branch = F.when(t.rlike(line), F.concat(F.lit("branch "), F.substring_index(F.regexp_extract(t, line, 1), "...", 1), F.lit("; "))).otherwise(F.lit(""))
    shown = lambda p: F.array_join(F.slice(p, 1, 5), ", ")
    more = lambda p: F.when(F.size(p) > 5, F.concat(F.lit(" and "), (F.size(p) - 5).cast("string"), F.lit(" others"))).otherwise(F.lit(""))

    def text(e: Column) -> Column:
        labels = F.array_sort(F.array_distinct(F.transform(e, lambda x: x["label"])))
        paths = lambda k: F.transform(F.filter(e, lambda x: x["label"] == k), lambda x: x["path"])
        rows = F.transform(labels, lambda k: let(paths(k), lambda p: F.concat(F.lit("  "), k, F.lit(" ("), F.size(p).cast("string"), F.lit("): "), shown(p), more(p))))
        head = F.concat(branch, F.size(e).cast("string"), F.lit(" paths in all"))
        return F.when(F.size(e) == 0, t).otherwise(F.array_join(F.concat(F.array(head), rows), "\n"))

    return let(git_entries(t), text)


def _or_text(kept: Column, t: Column) -> Column:
    return let(kept, lambda k: F.when(F.size(k) == 0, t).otherwise(F.array_join(k, "\n")))


def pytest_run(t: Column) -> Column:
    rule, none = r"^_{3,}.*_{3,}$", F.array().cast("array<string>")
    indent = lambda a: F.transform(a, lambda x: F.concat(F.lit("  "), x))

    def fails(f: Column) -> Column:
        many = F.when(F.size(f) > 20, F.array(F.concat(F.lit("  and "), (F.size(f) - 20).cast("string"), F.lit(" others")))).otherwise(none)
        return F.when(F.size(f) > 0, F.concat(F.array(F.concat(F.size(f).cast("string"), F.lit(" tests failed:"))), indent(F.slice(f, 1, 20)), many)).otherwise(none)

    def detail(d: Column) -> Column:
        return F.when(F.size(d) > 0, F.concat(F.array(F.lit("the first one:")), indent(F.slice(d, 1, 8)))).otherwise(none)

    def block(lines: Column, at: Column) -> Column:
        stop = F.coalesce(F.get(at, F.lit(1)), F.size(lines) + 1)
        inside = F.when(F.size(at) > 0, F.slice(lines, F.get(at, F.lit(0)) + 1, F.greatest(stop - F.get(at, F.lit(0)) - 1, F.lit(0)))).otherwise(none)
        return F.filter(inside, lambda x: x.startswith("E "))

    def kept(lines: Column) -> Column:
        failed = F.filter(lines, lambda x: x.rlike(f"^(FAILED|ERROR)[{WS}]"))
        summary = F.filter(lines, lambda x: x.rlike(r"\p{Nd}+ (passed|failed|error|skipped|deselected)"))
        at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(rule), i + 1)), lambda i: i.isNotNull())
        last = let(summary, lambda s: F.slice(s, F.greatest(F.size(s) - 1, F.lit(1)), F.lit(2)))
        return F.concat(let(failed, fails), let(let(at, lambda a: block(lines, a)), detail), last)

    return _or_text(let(split_lines(t), kept), t)


def install_log(t: Column) -> Column:
    none = F.array().cast("array<string>")
    note = lambda n, a, b: let(n, lambda k: F.when(k > 0, F.array(F.concat(F.lit(a), k.cast("string"), F.lit(b)))).otherwise(none))

    def kept(lines: Column) -> Column:
        starting = lambda p: F.filter(lines, lambda x: x.startswith(p))
        errors = F.slice(F.filter(lines, lambda x: x.rlike("^(ERROR|error)")), 1, 10)
        return F.concat(note(F.size(starting("Collecting")), "packages: ", ""), note(F.size(starting("Requirement already satisfied")), "already there: ", ""), errors, starting("Successfully installed"))

    return _or_text(let(split_lines(t), kept), t)


def shorter(result: Column, t: Column) -> Column:
    return let(result, lambda r: F.when(F.length(r) < F.length(t), r).otherwise(t))


def compress(t: Column, how: Column | None = None, cfg: EngineConfig = DEFAULT) -> Column:
    k = how if how is not None else kind(t)
    out = let(k, lambda k: F.when(k == "git-status", git_status(t)).when(k == "pytest", pytest_run(t)).when(k == "install", install_log(t)).otherwise(generic(t, cfg)))
    return F.when(t.isNull() | is_blank(t), t).otherwise(shorter(out, t))


def saved_percent(before: Column, after: Column) -> Column:
    """By how much the output is shorter, in whole percent; 0 for nothing."""
    return F.when(before > 0, F.bround((1 - after / before) * 100, 0)).otherwise(F.lit(0.0)).cast("int")
