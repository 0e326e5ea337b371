"""Pages of distilled documents: routing, accounting, rendering. A page table has doc_key, page_index, method, text, ocr_confidence,
ocr_word_count, raw_tokens_est, distilled_tokens_est, warnings, image_count, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxlake.config import DEFAULT, EngineConfig
from ctxlake.functions.text import text_tokens

PAGE = "array<struct<page_index:int,method:string,text:string,ocr_confidence:double,ocr_word_count:int,raw_tokens_est:int,distilled_tokens_est:int,warnings:array<string>,image_count:int,figures:array<string>>>"


def once(pages: DataFrame) -> DataFrame:
    """A page delivered again under its page_id counts once."""
    return pages.dropDuplicates(["page_id"])


def parse_pages(json: Column) -> Column:
    """Stored pages as structs; fields that old rows lack get 0 and the empty list."""
    return F.transform(F.from_json(json, PAGE), lambda p: p.withField("image_count", F.coalesce(p["image_count"], F.lit(0))).withField("figures", F.coalesce(p["figures"], F.array().cast("array<string>"))))


def native(text: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) >= cfg.min_native_chars


def needs_fallback(conf: Column, words: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return (F.coalesce(conf, F.lit(0.0)) < cfg.ocr_confidence) | (F.coalesce(words, F.lit(0)) < cfg.ocr_min_words)


def ocr_route(conf: Column, words: Column, vision_allowed: Column, vision_text: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """ocr if good or vision is not allowed; vision if it answered; else ocr_degraded."""
    good = ~needs_fallback(conf, words, cfg)
    return F.when(good | ~vision_allowed, F.lit("ocr")).when(vision_text.isNotNull(), F.lit("vision")).otherwise(F.lit("ocr_degraded"))


def needs_retry(conf: Column, words: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return ~((conf >= cfg.retry_confidence) & (words >= cfg.retry_min_words))


def best_pass(first: Column, second: Column) -> Column:
    """Of two OCR passes (words, confidence, text) the second only if strictly better by words, then confidence; a null pass loses."""
    key = lambda p: F.struct(p["words"].cast("int"), p["confidence"].cast("double"))
    return F.when(second.isNotNull() & (first.isNull() | (key(second) > key(first))), second).otherwise(first)


def text_with_figures(text: Column, figures: Column, page_index: Column) -> Column:
    blocks = F.transform(F.coalesce(figures, F.array().cast("array<string>")), lambda f, i: F.concat(F.lit("[figure "), (i + 1).cast("string"), F.lit(" on page "), (page_index + 1).cast("string"), F.lit("] "), f))
    body = F.array_join(blocks, "\n\n")
    text = F.coalesce(text, F.lit(""))
    return F.when(F.size(blocks) == 0, text).when(text == "", body).otherwise(F.concat(text, F.lit("\n\n"), body))


def ordered(value: Column, index: Column) -> Column:
    """All values of a group in the order of ``index``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(index.alias("i"), value.alias("v")))), lambda x: x["v"])


def page_list(pages: Column, most: int = 8) -> Column:
    shown = F.array_join(F.transform(F.slice(pages, 1, most), lambda p: (p + 1).cast("string")), ", ")
    return F.when(F.size(pages) > most, F.concat(shown, F.lit(" and "), (F.size(pages) - most).cast("string"), F.lit(" others"))).otherwise(shown)


def documents(pages: DataFrame) -> DataFrame:
    """A row a document: page_count, raw and distilled tokens, ratio, counts by method (and all of them as text: methods), mean confidence, figures, notes, warnings, text."""
    figures = F.coalesce(F.col("figures"), F.array().cast("array<string>"))
    uncaptured = (F.col("method") == "native_text") & (F.coalesce("image_count", F.lit(0)) > 0) & (F.size(figures) == 0)
    some = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("page_index"))))
    count = lambda m: F.count_if(F.col("method").isin(*m))
    d = pages.groupBy("doc_key").agg(
        F.count("*").alias("page_count"),
        F.sum(F.coalesce("raw_tokens_est", F.lit(0))).alias("raw_tokens"),
        F.sum(F.coalesce("distilled_tokens_est", F.lit(0))).alias("distilled_tokens"),
        count(["native_text"]).alias("pages_native"),
        count(["ocr", "ocr_degraded"]).alias("pages_ocr"),
        count(["ocr_degraded"]).alias("pages_degraded"),
        count(["vision"]).alias("pages_vision"),
        count(["ocr"]).alias("_ocr"),
        F.avg("ocr_confidence").alias("mean_confidence"),
        F.sum(F.size(figures)).alias("figure_count"),
        some(uncaptured).alias("uncaptured"),
        some(F.size(figures) > 0).alias("described"),
        F.flatten(ordered(F.coalesce("warnings", F.array().cast("array<string>")), F.col("page_index"))).alias("warnings"),
        F.array_join(ordered(text_with_figures(F.col("text"), figures, F.col("page_index")), F.col("page_index")), "\n\n").alias("text"),
    )
    told = [F.when(F.col(c) > 0, F.concat(F.lit(f"{m} "), F.col(c).cast("string"))) for m, c in (("native_text", "pages_native"), ("ocr", "_ocr"), ("ocr_degraded", "pages_degraded"), ("vision", "pages_vision"))]
    d = d.withColumn("methods", F.concat_ws(", ", *told)).drop("_ocr")
    d = d.withColumn("ratio", F.col("raw_tokens") / F.greatest(F.lit(1), F.col("distilled_tokens")))
    fig = F.concat(F.col("figure_count").cast("string"), F.lit(" figure(s) of "), F.size("described").cast("string"), F.lit(" page(s) stand in the text as [figure N on page M]: pages "), page_list(F.col("described")))
    unc = F.concat(F.lit("images of "), F.size("uncaptured").cast("string"), F.lit(" page(s) have no text here: pages "), page_list(F.col("uncaptured")))
    return d.withColumn("figures_note", F.when(F.size("described") > 0, fig)).withColumn("uncaptured_note", F.when(F.size("uncaptured") > 0, unc))


#: How tokens were estimated, in the run log.
ESTIMATE = "code points / 4, images by area"


def run_rows(docs: DataFrame, trigger: str, ts: Column | None = None) -> DataFrame:
    """Rows of the run log from documents(), with source_path, source_type and duration_ms where given; ``ts`` is the time of writing unless given."""
    label = F.when(F.col("pages_vision") > 0, "vision").when(F.col("pages_ocr") > 0, "ocr").otherwise("native_text")
    given = [F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("source_path", "string"), ("source_type", "string"), ("duration_ms", "long"))]
    return docs.select(
        (F.current_timestamp() if ts is None else ts).cast("timestamp").alias("ts"), "doc_key", *given, F.lit(trigger).alias("trigger"), "page_count", "pages_native", "pages_ocr", "pages_vision", F.round("mean_confidence", 4).alias("mean_confidence"), label.alias("method"),
        "raw_tokens", "distilled_tokens", F.lit(ESTIMATE).alias("estimate"), F.round("ratio", 4).alias("ratio"), F.col("pages_vision").alias("vision_calls"), F.lit(None).cast("string").alias("vision_model"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("output_path"),
    )


def failed_runs(distilled: DataFrame, trigger: str) -> DataFrame:
    """Rows of the run log for files that could not be read (content_hash, path, source_type, error of distill()); the other columns are null."""
    bad = distilled.where("error IS NOT NULL")
    return bad.select(F.current_timestamp().alias("ts"), F.col("content_hash").alias("doc_key"), F.col("path").alias("source_path"), "source_type", F.lit(trigger).alias("trigger"), F.lit("error").alias("status"), "error")


def append_runs(runs: DataFrame, path: str) -> None:
    """Add to the run log. Files are only added, so writers at the same time do not meet; each row gets an id that no other has."""
    runs.withColumn("run_id", F.expr("uuid()")).write.mode("append").parquet(path)


def recent_runs(runs: DataFrame, since: str | None = None, limit: int = 50) -> DataFrame:
    """The latest runs, newest first: a top-k, no full sort."""
    r = runs if since is None else runs.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return r.orderBy(F.desc("ts"), F.desc("doc_key")).limit(limit)


def result_json() -> Column:
    """The result of a document as JSON: 13 fields, of the columns of documents() with source_path, source_type and duration_ms."""
    methods = F.map_filter(F.map_from_arrays(F.array(*[F.lit(m) for m in ("native_text", "ocr", "ocr_degraded", "vision")]), F.array(F.col("pages_native"), F.col("pages_ocr") - F.col("pages_degraded"), F.col("pages_degraded"), F.col("pages_vision"))), lambda k, v: v > 0)
    return F.to_json(F.struct(
        "source_path", "source_type", "page_count", methods.alias("method_counts"), F.col("raw_tokens").alias("raw_tokens_est"), F.col("distilled_tokens").alias("distilled_tokens_est"), F.round("ratio", 2).alias("compression_ratio"), "duration_ms", "warnings",
        F.col("uncaptured").alias("pages_with_uncaptured_images"), F.col("described").alias("pages_with_described_figures"), "figure_count", "text",
    ), {"ignoreNullFields": "false"})


def savings(runs: DataFrame, since: str | None = None) -> DataFrame:
    """One row: runs, raw, distilled, saved tokens and ratio (0 where nothing is left) of the successful runs."""
    r = runs.where("status = 'ok'")
    if since is not None:
        r = r.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    s = r.agg(F.count("*").alias("runs"), F.coalesce(F.sum("raw_tokens"), F.lit(0)).alias("raw_tokens"), F.coalesce(F.sum("distilled_tokens"), F.lit(0)).alias("distilled_tokens"))
    return s.withColumn("saved_tokens", F.greatest(F.lit(0), F.col("raw_tokens") - F.col("distilled_tokens"))).withColumn("ratio", F.round(F.when(F.col("distilled_tokens") == 0, F.lit(0.0)).otherwise(F.col("raw_tokens") / F.col("distilled_tokens")), 6))


def words_read(words: Column) -> Column:
    """STRUCT<text, confidence, words> of what a recogniser found (array of text, conf): boxes without text, without a number as confidence or with a negative
    one are no words; the confidence is the mean of the words', 0 without any."""
    ok = F.filter(words, lambda w: (F.trim(w["text"]) != "") & (F.coalesce(w["conf"].try_cast("double"), F.lit(-1.0)) >= 0))
    total = F.aggregate(ok, F.lit(0.0), lambda s, w: s + w["conf"].try_cast("double"))
    return F.struct(F.array_join(F.transform(ok, lambda w: F.trim(w["text"])), " ").alias("text"), F.when(F.size(ok) > 0, total / F.size(ok)).otherwise(F.lit(0.0)).alias("confidence"), F.size(ok).alias("words"))


def otsu(levels: DataFrame, by: str, level: str) -> DataFrame:
    """Binarisation threshold of each group of grey levels (0-255): midpoint of the plateau of greatest between-class variance; 128 where one
    level holds everything. Works on histograms, so at most 256 values a group are sorted."""
    from pyspark.sql import Window as W

    h = levels.where(F.col(level).between(0, 255)).groupBy(by, level).agg(F.count("*").cast("double").alias("n"))
    sums = h.groupBy(by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col(level)).alias("mass"))
    full = sums.select(by, "total", "mass", F.explode(F.sequence(F.lit(0), F.lit(255))).alias(level)).join(h, [by, level], "left")
    w = W.partitionBy(by).orderBy(level).rowsBetween(W.unboundedPreceding, 0)
    c = full.withColumn("w0", F.sum(F.coalesce("n", F.lit(0.0))).over(w)).withColumn("s0", F.sum(F.coalesce("n", F.lit(0.0)) * F.col(level)).over(w))
    m0, m1 = F.col("s0") / F.col("w0"), (F.col("mass") - F.col("s0")) / (F.col("total") - F.col("w0"))
    c = c.where("w0 > 0 AND total - w0 > 0").withColumn("var", F.col("w0") * (F.col("total") - F.col("w0")) * (m0 - m1) * (m0 - m1))
    top = c.withColumn("best", F.max("var").over(W.partitionBy(by))).where("var = best AND var > 0").groupBy(by).agg(F.min(level).alias("lo"), F.max(level).alias("hi"))
    return sums.select(by).join(top, by, "left").select(by, F.coalesce(F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"), F.lit(128)).alias("threshold"))


def recount(pages: DataFrame) -> DataFrame:
    """Distilled tokens from a page's text and figures."""
    fig = F.aggregate(F.coalesce("figures", F.array().cast("array<string>")), F.lit(0).cast("long"), lambda s, f: s + text_tokens(f))
    return pages.withColumn("distilled_tokens_est", (text_tokens("text") + fig).cast("int"))
