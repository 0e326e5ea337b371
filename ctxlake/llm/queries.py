"""Registered queries of the training-data problems: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlake.llm import dedup, knn, language, lookalike, mixing, ocr, runs, split, tokenizer
from ctxlake.runtime import spread, table


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and distilled documents under one id: twice the own id, plus 1 for distillations."""
    chunks = table(spark, d, "chunks").select((F.col("chunk_id") * 2).alias("gid"), F.lit(0).alias("part"), "text")
    return chunks.unionByName(dedup.page_texts(table(spark, d, "distillations")).select((F.col("id") * 2 + 1).alias("gid"), F.lit(1).alias("part"), "text"))


def _kind(gid: Column) -> Column:
    return F.when(gid % 2 == 0, F.lit("chunk")).otherwise(F.lit("distillation"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    p = dedup.near_pairs(_records(spark, d), size=3, min_words=20, threshold=0.5)
    return p.select(_kind(F.col("a")).alias("item_kind"), F.expr("a div 2").alias("id_a"), F.expr("b div 2").alias("id_b"))


def _groups(spark: SparkSession, d: str, **how) -> DataFrame:
    """One row a record: the class of its exact set of shingles, its size, the number of other classes near it, and the group that such links connect."""
    members, links = dedup.classes(_records(spark, d), **how)
    both = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    m = members.join(both, "rep", "left").join(dedup.components(links).withColumnRenamed("node", "rep"), "rep", "left")
    return m.select(_kind(F.col("gid")).alias("item_kind"), F.expr("gid div 2").alias("item_id"), F.expr("rep div 2").alias("class_id"), "n", F.coalesce("links", F.lit(0)).alias("links"), F.expr("coalesce(group_id, rep) div 2").alias("group_id"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """With five words and 0.8."""
    return _groups(spark, d)


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """With the parameters of p1_found: the membership behind its pairs."""
    return _groups(spark, d, size=3, threshold=0.5)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "chunks")).where("piece_index = 0").select("chunk_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    p = split.split_oversized(table(spark, d, "chunks"), extra=("source_path", "chunk_index"))
    return p.select("chunk_id", "source_path", F.col("chunk_index").alias("parent_index"), F.col("piece_index").alias("chunk_index"), "begin", "end", F.col("piece_text").alias("text"), F.col("piece_tokens").alias("token_count"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "activity_log"), min_events=2).select("session_id", "first_seq", "last_seq")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "activity_log"))


def p3_near_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of near-identical events: half of the letter pairs shared with the first event of the run."""
    return runs.collapse_runs(table(spark, d, "activity_log"), min_similarity=0.5)


def _items(spark: SparkSession, d: str, chunks: str) -> DataFrame:
    """Pages and those chunks that fit the condition: item_kind, item_id, text."""
    pages = table(spark, d, "page_results").select(F.lit("page").alias("item_kind"), F.col("page_id").alias("item_id"), "text")
    return pages.unionByName(table(spark, d, "chunks").where(chunks).select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text"))


_PROSE = r"source_path IS NULL OR NOT source_path RLIKE '[.](log|py|toml)$'"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = language.mislabelled(_items(spark, d, _PROSE), table(spark, d, "word_list"), table(spark, d, "lang_labels"))
    return found.select("item_kind", "item_id", "lang")


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    s = language.segments(_items(spark, d, _PROSE), table(spark, d, "word_list"))
    return s.select("item_kind", "item_id", F.posexplode("segments").alias("segment", "s")).select("item_kind", "item_id", "segment", "s.lang", "s.begin", "s.end", "s.chars", "s.confidence").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    p = knn.near_pairs(table(spark, d, "chunk_embeddings"), k=5, min_cosine=0.9)
    return p.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p5_knn(spark: SparkSession, d: str) -> DataFrame:
    n = knn.neighbours(table(spark, d, "chunk_embeddings"), k=5, query_every=20, probes=24)
    return n.select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), "rank", F.round("cosine", 4).alias("cosine"))


def _originals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Paged originals (item_kind, item_id, key, text), each page once, and the texts that never saw a scanner (key, text)."""
    pages, chunks = table(spark, d, "page_results"), spread(table(spark, d, "chunks"))
    once = pages.groupBy("page_id").agg(F.max(F.struct("doc_key", "text", "method")).alias("p")).select(F.lit("page").alias("item_kind"), F.col("page_id").alias("item_id"), F.col("p.doc_key").alias("key"), "p.text")
    scans = chunks.where(r"source_path RLIKE '[.](pdf|png|tiff|jpg)$'").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("source_path").alias("key"), "text")
    born = pages.where("method = 'native_text'").select(F.col("doc_key").alias("key"), "text")
    born = born.unionByName(chunks.where(r"source_path RLIKE '[.](md|txt)$'").select(F.col("source_path").alias("key"), "text"))
    return once.unionByName(scans), born


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.damage(*_originals(spark, d))


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    return ocr.repair(*_originals(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents in training order, with the position of their first use."""
    docs = mixing.sized(table(spark, d, "documents"))
    m = mixing.placed(docs, table(spark, d, "mix_targets"))
    return m.select("doc_id", "source", "n_tokens", "repeats", F.col("positions")[0].alias("position")).orderBy("position", "source", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p8_order(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document, in training order."""
    return mixing.curriculum(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents")).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unify(table(spark, d, "documents"))


def queries() -> dict:
    names = ("p1_found", "p1_classes", "p1_groups", "p2_found", "p2_pieces", "p3_found", "p3_runs", "p3_near_runs", "p4_found", "p4_segments", "p5_found", "p5_knn", "p6_found", "p6_text", "p7_ids", "p8_order", "p8_mix", "p8_shares", "p9_found", "p9_forms")
    return {n: globals()[n] for n in names}
