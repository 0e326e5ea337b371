"""Lines repeated on most pages of a document: detect, list once, strip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxlake.config import DEFAULT, EngineConfig
from ctxlake.functions.text import strip


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def find(pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """doc_key, line, n_pages: stripped lines of at most the longest length on at least max(3, 80 %) of a document's pages."""
    size = pages.groupBy("doc_key").agg(F.count("*").alias("pages"))
    seen = pages.select("doc_key", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: strip(x)))).alias("line"))
    seen = seen.where((F.col("line") != "") & (F.length("line") <= cfg.boilerplate_max_chars)).groupBy("doc_key", "line").agg(F.count("*").alias("n_pages"))
    return seen.join(size, "doc_key").where((F.col("pages") >= cfg.boilerplate_min_pages) & (F.col("n_pages") >= F.greatest(F.lit(float(cfg.boilerplate_min_pages)), F.col("pages") * F.lit(cfg.boilerplate_fraction)))).select("doc_key", "line", "n_pages")


def _sets(pages: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Every page with its document's repeated lines (a short list: each takes at least 80 % of the pages)."""
    return pages.join(find(pages, cfg).groupBy("doc_key").agg(F.array_sort(F.collect_list("line")).alias("bp")), "doc_key", "left").withColumn("bp", F.coalesce("bp", F.array().cast("array<string>")))


def strip_pages(pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The pages without their document's repeated lines, stripped; documents without such lines stay untouched."""
    kept = strip(F.array_join(F.filter(_lines(F.col("text")), lambda x: ~F.array_contains(F.col("bp"), strip(x))), "\n"))
    return _sets(pages, cfg).withColumn("text", F.when(F.size("bp") > 0, kept).otherwise(F.col("text"))).drop("bp")


def manifest(pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """doc_key, line, occurrences: each repeated line with every instance counted."""
    inst = _sets(pages, cfg).where(F.size("bp") > 0).select("doc_key", F.explode(F.filter(F.transform(_lines(F.col("text")), lambda x: strip(x)), lambda x: F.array_contains(F.col("bp"), x))).alias("line"))
    return inst.groupBy("doc_key", "line").agg(F.count("*").alias("occurrences"))


def render(entries: Column, tag: str = DEFAULT.tag) -> Column:
    """The manifest (array of line, occurrences; by line) as text; empty for none."""
    rows = F.transform(entries, lambda e: F.concat(F.lit("  ("), e["occurrences"].cast("string"), F.lit("x) "), e["line"]))
    return F.when(F.size(entries) > 0, F.concat(F.lit(f"{tag} lines of most pages, given here once:\n"), F.array_join(rows, "\n"))).otherwise(F.lit(""))


def rendered(docs: DataFrame, manifests: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """docs (doc_key, text) with rendered_text: the manifest, a blank line, the text."""
    m = manifests.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("line", "occurrences"))).alias("entries"))
    both = docs.join(m, "doc_key", "left")
    return both.withColumn("rendered_text", F.when(F.size("entries") > 0, F.concat(render(F.col("entries"), cfg.tag), F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))).drop("entries")


def tallies(manifests: DataFrame) -> DataFrame:
    """doc_key, n_lines, n_occurrences: how many lines were taken out of a document, and how often in all."""
    return manifests.groupBy("doc_key").agg(F.count("*").alias("n_lines"), F.sum("occurrences").alias("n_occurrences"))
