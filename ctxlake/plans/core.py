"""Registered queries of the core operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ctxlake.functions import images as I
from ctxlake.functions import text as T
from ctxlake.functions import tokens as K
from ctxlake.operators import activity, audit, boilerplate, chunking, compress, distill, flows, pack, pages, retrieval, sessions, store
from ctxlake.plans import fixtures
from ctxlake.plans.core_sql import oracle_sql
from ctxlake.sources import files, images, pdf
from ctxlake.runtime import checkpointed, hadoop_path, new_folder, spread, table
from ctxlake.streaming import activity as streams
from ctxlake.streaming.run import drain, parquet_stream

__all__ = ["oracle_sql", "queries"]

QUESTIONS = ((1, "northern harbour library"), (2, "the signature of the contract"), (3, "backup snapshot tokenizer"), (4, "zzqqxx"), (5, "pump pump valve"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    return pages.once(table(s, d, "page_results"))


def _events(s: SparkSession, d: str) -> DataFrame:
    """Each event once, with its bucket in one spelling."""
    b = F.regexp_replace(F.lower(F.regexp_replace("bucket", r"[\s_-]", "")), "^bash(test|git|infra)$", "bash_$1")
    return table(s, d, "activity_log").dropDuplicates(["seq"]).withColumn("bucket", b)


def _questions(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(QUESTIONS), "q long, question string")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return pages.documents(_pages(s, d))


def _runs(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "distillations").select(F.col("content_hash").alias("doc_key"), "source_path", "source_type", "duration_ms", "created_at")
    return pages.run_rows(_docs(s, d).join(x, "doc_key"), "scan", F.col("created_at"))


def _logs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text"))


def _log_text(s: SparkSession, d: str) -> DataFrame:
    """Test-run and install logs made of the rows of lineitem, one for each supplier: long enough for every limit of the compressors."""
    line = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("."), F.col("l_linenumber").cast("string"))
    listed = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line.alias("k"), x.alias("v")))), lambda r: r["v"]), "\n")
    rows = table(s, d, "lineitem").groupBy("l_suppkey").agg(
        listed(F.concat(F.lit("FAILED tests/part_"), F.col("l_partkey").cast("string"), F.lit(" - wrong"))).alias("f"),
        listed(F.concat(F.lit("E   row "), line)).alias("e"),
        listed(F.concat(F.lit("Collecting pkg"), F.col("l_partkey").cast("string"), F.lit("\n  Downloading pkg.whl"))).alias("c"),
        listed(F.when(F.col("l_quantity") > 30, F.concat(F.lit("ERROR: row "), line)).otherwise(F.lit("Requirement already satisfied: base"))).alias("r"),
        F.count("*").alias("n"),
    )
    test = F.concat(F.lit("=== test session starts ===\ncollected 99 items\n...F..\n=== FAILURES ===\n___ test_a ___\n"), F.col("e"), F.lit("\n___ test_b ___\nE   later\n"), F.col("f"), F.lit("\n"), F.col("n").cast("string"), F.lit(" failed, 3 passed in 0.12s\n"))
    return rows.select("l_suppkey", test.alias("test"), F.concat("c", F.lit("\n"), "r", F.lit("\nSuccessfully installed pkg\n")).alias("install"))


def _boxes(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    b = F.struct((F.col("l_suppkey") % 600 * 1.0).alias("x0"), (F.col("l_partkey") % 700 * 1.0).alias("y0"), (F.col("l_suppkey") % 600 + F.col("l_quantity") * 3).alias("x1"), (F.col("l_partkey") % 700 + F.col("l_linenumber") * 20.0).alias("y1"))
    return li.select("l_orderkey", "l_linenumber", b.alias("b"))


def _tree(s: SparkSession, d: str) -> DataFrame:
    """Chunks as files of a tree, and parts as files of other kinds."""
    chunks = spread(table(s, d, "chunks").where("text IS NOT NULL")).select(F.concat(F.substring("source_path", 2, 1000), F.lit("."), F.col("chunk_id").cast("string"), F.regexp_extract("source_path", r"(\.[a-z]+)$", 1)).alias("path"), F.encode("text", "UTF-8").alias("content"))
    name, kind = F.concat(F.lit("f"), F.col("p_partkey").cast("string")), F.col("p_partkey") % 6
    path = F.when(kind == 2, F.concat(F.lit("odd/.pytest_cache/"), name, F.lit(".txt"))).otherwise(F.concat(F.lit("odd/"), name, F.element_at(F.array(*map(F.lit, (".db", ".bin", "", ".SQLITE3", ".mov", ".txt"))), kind.cast("int") + 1)))
    return chunks.unionByName(table(s, d, "part").select(path.alias("path"), F.encode("p_name", "UTF-8").alias("content")))


def _distilled(s: SparkSession, d: str) -> DataFrame:
    """What distilling gave for the chunks with a distillable name: some failed, some are not there."""
    n = F.col("chunk_id")
    t = table(s, d, "chunks").where("text IS NOT NULL").where(n % 7 > 0).select(F.concat(F.substring("source_path", 2, 1000), F.lit("."), n.cast("string"), F.regexp_extract("source_path", r"(\.[a-z]+)$", 1)).alias("path"), F.when(n % 5 > 0, F.concat("text", F.lit("\n(read)"))).alias("text"), F.when(n % 5 > 0, n % 100).alias("tokens"), F.when(n % 5 == 0, "broken file").alias("error"))
    return t.where(sessions.suffix(F.col("path")).isin(*pack.DEFAULT.distillable))


def _whole_pack(s: SparkSession, d: str) -> DataFrame:
    return pack.pack(_tree(s, d), distilled=_distilled(s, d))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    """doc, model, vector of all vectors of their model's length."""
    v = table(s, d, "chunk_embeddings").where("(model = 'lattice-64' AND size(vector) = 64) OR (model = 'lattice-48' AND size(vector) = 48)")
    return v.select(F.col("chunk_id").alias("doc"), "model", "vector")


def _asked(s: SparkSession, d: str) -> DataFrame:
    """q, model, qv: the vector of each question is that of the model's q-th least chunk."""
    w = W.Window.partitionBy("model").orderBy("doc")
    return _vectors(s, d).withColumn("q", F.row_number().over(w).cast("long")).where(F.col("q") <= len(QUESTIONS)).select("q", "model", F.col("vector").alias("qv"))


_INDEXES: dict[tuple, str] = {}


def _index(s: SparkSession, d: str) -> retrieval.Index:
    """The stored index of the chunks: built once for a session and state of the table, then opened."""
    path, fs = hadoop_path(s, f"{d}/chunks.parquet")
    at = fs.getFileStatus(path)
    key = (s.sparkContext.applicationId, d, at.getModificationTime(), at.getLen())
    if key not in _INDEXES:
        where = new_folder(s, "index")
        retrieval.build(table(s, d, "chunks"), "chunk_id", where)
        _INDEXES[key] = where
    return retrieval.opened(s, _INDEXES[key])


def _scored(s: SparkSession, d: str) -> DataFrame:
    return retrieval.normalised(retrieval.scores(_index(s, d), _questions(s)), _questions(s))


def _best(s: SparkSession, d: str, k: int = 5) -> DataFrame:
    return retrieval.top_k(_scored(s, d), _index(s, d).lengths, _questions(s), k)


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    both = retrieval.blend(_scored(s, d), retrieval.cosines(_vectors(s, d), _asked(s, d)))
    return retrieval.top_k(both, _index(s, d).lengths, _questions(s), 10)


def _fresh(s: SparkSession, d: str) -> DataFrame:
    """A new index of every source whose name ends in 7.pdf."""
    c = table(s, d, "chunks").where("source_path LIKE '%7.pdf' AND chunk_index = 0")
    return c.withColumn("text", F.concat("text", F.lit(" (new)"))).withColumn("chunk_id", F.col("chunk_id") + 100_000_000)


def _cached(s: SparkSession, d: str) -> DataFrame:
    """The cached documents with their rendered text."""
    docs = _docs(s, d).join(table(s, d, "distillations").select(F.col("content_hash").alias("doc_key"), F.col("id").alias("handle"), "source_path", "source_type", "duration_ms", "boilerplate_json"), "doc_key")
    entries = F.coalesce(F.from_json("boilerplate_json", "array<struct<line:string,occurrences:int>>"), F.array().cast("array<struct<line:string,occurrences:int>>"))
    return docs.withColumn("rendered_text", F.when(F.size(entries) > 0, F.concat(boilerplate.render(entries), F.lit("\n\n"), F.col("text"))).otherwise(F.col("text")))


def _reads(r: DataFrame) -> DataFrame:
    """Reads as the reader's tool sends them: some of other files, some of a part."""
    path = F.when(F.col("id") % 11 == 0, "notes/todo.md").otherwise(F.concat(F.lit("/data/"), F.col("content_hash"), F.lit(".PDF")))
    none = F.lit(None).cast("string")
    return r.select("id", "session_id", "content_hash", "seen_at", path.alias("file_path"), none.alias("pages"), F.when(F.col("id") % 7 == 0, 1).alias("offset"), none.alias("limit"))


def _decisions(s: SparkSession, d: str) -> DataFrame:
    return sessions.decisions(_reads(table(s, d, "session_reads")), sessions.shown_documents(_cached(s, d)))


def _decision_stream(s: SparkSession, d: str) -> DataFrame:
    shown = checkpointed(sessions.shown_documents(_cached(s, d)))  # the table of documents, read in each micro-batch
    stream = parquet_stream(s, f"{d}/session_reads.parquet", table(s, d, "session_reads").schema)
    out = drain(streams.decision_stream(_reads(stream), shown), "append").dropDuplicates(["id"])
    return out.select("id", "decision", "branch", _told().alias("sha"))


def _calls(reads: DataFrame) -> DataFrame:
    """Reads as tool calls of several kinds."""
    return reads.select("session_id", F.col("seen_at").alias("ts"), F.when(F.col("id") % 2 == 0, "Read").otherwise("Bash").alias("tool_name"), F.when(F.col("id") % 3 == 0, "go test ./...").alias("command"))


def _recording(s: SparkSession, d: str) -> DataFrame:
    where = new_folder(s, "log")
    stream = parquet_stream(s, f"{d}/session_reads.parquet", table(s, d, "session_reads").schema)
    streams.recording(_calls(stream), where, _events(s, d)).awaitTermination()
    return streams.recorded_log(s, where).select("seq", "session_id", "tool_name", "bucket")


def _told():
    return F.sha2(F.get_json_object("response", "$.hookSpecificOutput.permissionDecisionReason"), 256)


def _large(s: SparkSession, d: str) -> DataFrame:
    """Documents made long by repetition, as a reader gets them."""
    t = table(s, d, "documents").select("doc_id", F.repeat(F.concat("text", F.lit("\n")), 60).alias("text")).where("text IS NOT NULL")
    reread = F.col("doc_id") % 5 == 0
    return t.select("doc_id", sessions.branch(F.col("text"), reread).alias("branch"), F.sha2(sessions.body(F.lit("head"), F.col("text"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")), reread), 256).alias("sha"))


def _notes(s: SparkSession, d: str) -> DataFrame:
    """Notes named after customers, suppliers and nations; each nation's note mentions itself and one supplier."""
    of = lambda t, name, text: table(s, d, t).select(F.concat(F.lit("memory/"), F.col(name), F.lit(".md")).alias("path"), text.alias("text"))
    own = F.concat(F.lit("about "), F.col("n_name"), F.lit(" and xSupplier#"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 9, "0"), F.lit("x"))
    return of("customer", "c_name", F.lit("nothing")).unionByName(of("supplier", "s_name", F.lit(""))).unionByName(of("nation", "n_name", own))


def _mentioning(s: SparkSession, d: str) -> DataFrame:
    """Texts that mention customers and nations."""
    o = table(s, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.concat(F.lit("see Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" and more")).alias("text"))
    return o.unionByName(table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), F.concat(F.lit("in "), F.col("n_name"), F.lit(".")).alias("text")))


def _found_words(s: SparkSession, d: str) -> DataFrame:
    """Boxes of a recogniser, made of the rows of lineitem."""
    k = F.col("l_partkey")
    text = F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit(" w"), k.cast("string"), F.lit(" ")))
    conf = F.when(k % 5 == 0, "-1").when(k % 7 == 0, "n/a").otherwise((k % 100).cast("string"))
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("text"), conf.alias("conf")))).alias("w"))
    return rows.select("l_orderkey", pages.words_read(F.col("w")).alias("r")).select("l_orderkey", "r.text", F.round("r.confidence", 6).alias("confidence"), "r.words")


def _results(s: SparkSession, d: str) -> DataFrame:
    j = _cached(s, d).withColumn("j", pages.result_json())
    g = lambda k: F.get_json_object("j", f"$.{k}")
    return j.select("doc_key", F.array_join(F.json_object_keys("j"), ",").alias("keys"), g("page_count").cast("long").alias("page_count"), g("method_counts.native_text").cast("long").alias("native"), g("method_counts.ocr_degraded").cast("long").alias("degraded"), g("compression_ratio").cast("double").alias("ratio"), g("figure_count").cast("long").alias("figures"), F.sha2(g("text"), 256).alias("sha"))


def _page_rows(p: DataFrame) -> DataFrame:
    return p.select("path", "page_index", "method", F.sha2("text", 256).alias("sha"), "ocr_confidence", "ocr_word_count", "raw_tokens_est", "distilled_tokens_est", F.array_join("warnings", "|").alias("warnings"), "image_count", F.array_join("figures", "|").alias("figures"), F.substring_index("error", ":", 1).alias("error"))


def _distill(s: SparkSession, d: str) -> DataFrame:
    """Files of which half are in the cache, with other figures' options for some: those are read again."""
    f = fixtures.files(s, d)
    read = distill.read_pages(f.where("ascii(substring(content_hash, 1, 1)) % 2 = 0"), fixtures.STAND_INS).where("error IS NULL")
    wrong = F.ascii(F.substring("content_hash", 2, 1)) % 2 == 0
    cache = checkpointed(read.withColumn("options", F.when(wrong, "vision=True,figures=False").otherwise("vision=True,figures=True")))
    return checkpointed(distill.distill(f, cache, fixtures.STAND_INS))  # read once for all that is made of it


def _indexed_tree(s: SparkSession, d: str) -> DataFrame:
    v = flows.index_tree(_tree(s, d), new_folder(s, "tree"), distilled=_distilled(s, d))
    return v.chunks.select("source_path", "chunk_index", "token_count", F.sha2("text", 256).alias("sha"))


def queries() -> dict:
    t = table
    q = {
        "bm25_topk": _best,
        "text_tokens": lambda s, d: t(s, d, "documents").select("doc_id", T.text_tokens("text").alias("tokens")),
        "image_tokens": lambda s, d: t(s, d, "part").select("p_partkey", K.image_tokens(F.col("p_size") * 97 - 60, F.col("p_partkey") % 3000 - 2).alias("tokens")),
        "downscaled": lambda s, d: t(s, d, "part").select("p_partkey", K.downscaled(F.col("p_size") * 97, F.col("p_partkey") % 3000 + 1).alias("x")).select("p_partkey", "x.w", "x.h"),
        "page_host_tokens": lambda s, d: _pages(s, d).select("page_id", K.page_host_tokens(F.col("page_id") % 700 + 300, F.col("page_id") % 500 + 400.5, F.col("text")).alias("tokens")),
        "figure_boxes": lambda s, d: _boxes(s, d).select("l_orderkey", "l_linenumber", F.size(K.large_enough(F.array("b"))).alias("kept")),
        "crop_geometry": lambda s, d: _boxes(s, d).select("l_orderkey", "l_linenumber", K.crop(F.col("b"), F.lit(792.0), F.lit(1275), F.lit(1650), 150.0).alias("c")).select("l_orderkey", "l_linenumber", "c.left", "c.top", "c.right", "c.bottom"),
        "otsu_threshold": lambda s, d: pages.otsu(t(s, d, "part").select("p_brand", (F.col("p_size") * 5 % 256).alias("level")), "p_brand", "level"),
        "doc_compression": lambda s, d: _docs(s, d).select("doc_key", "page_count", "raw_tokens", "distilled_tokens", F.round("ratio", 6).alias("ratio")),
        "method_counts": lambda s, d: _pages(s, d).groupBy("doc_key", "method").agg(F.count("*").alias("n")),
        "mean_confidence": lambda s, d: _docs(s, d).select("doc_key", F.round("mean_confidence", 4).alias("mean_confidence")),
        "doc_text": lambda s, d: _docs(s, d).select("doc_key", "text"),
        "doc_notes": lambda s, d: _docs(s, d).select("doc_key", "figure_count", "figures_note", "uncaptured_note", F.array_join("warnings", "|").alias("warnings")),
        "native_pages": lambda s, d: _pages(s, d).where(pages.native(F.col("text"))).select("page_id"),
        "uncaptured_pages": lambda s, d: _docs(s, d).select("doc_key", F.explode("uncaptured").alias("page_index")),
        "ocr_route": lambda s, d: _pages(s, d).select("page_id", pages.ocr_route(F.col("ocr_confidence"), F.col("ocr_word_count"), F.col("page_id") % 3 > 0, F.when(F.col("page_id") % 2 == 0, F.col("text"))).alias("route"), pages.needs_retry(F.col("ocr_confidence"), F.col("ocr_word_count")).alias("retry")).where("retry IS NOT NULL"),
        "ocr_best_of_two": lambda s, d: _pages(s, d).where("ocr_word_count IS NOT NULL AND ocr_confidence IS NOT NULL").select("page_id", pages.best_pass(F.struct(F.col("ocr_word_count").alias("words"), F.col("ocr_confidence").alias("confidence"), F.lit("raw").alias("text")), F.struct((F.col("distilled_tokens_est") % 200).alias("words"), F.lit(75.0).alias("confidence"), F.lit("retry").alias("text")))["text"].alias("kept")),
        "parsed_pages": lambda s, d: t(s, d, "distillations").select("id", F.explode(pages.parse_pages(F.col("pages_json"))).alias("p")).select("id", "p.page_index", "p.method", "p.text", "p.image_count", F.size("p.figures").alias("figures")),
        "page_recount": lambda s, d: pages.recount(_pages(s, d)).select("page_id", "distilled_tokens_est"),
        "run_log": lambda s, d: _runs(s, d).drop("vision_model", "error", "output_path"),
        "runs_recent": lambda s, d: pages.recent_runs(_runs(s, d), "2009-03-04").select("ts", "doc_key", "source_path", "method", "ratio"),
        "result_json": _results,
        "words_read": _found_words,
        "savings_report": lambda s, d: pages.savings(_runs(s, d)),
        "savings_since": lambda s, d: pages.savings(_runs(s, d), "2009-03-04"),
        "pdf_pages": lambda s, d: pdf.pages(fixtures.files(s, d).where("path LIKE '%.pdf'")).select("path", "page_index", F.sha2("text", 256).alias("sha"), "width", "height", F.to_json("boxes").alias("boxes"), F.substring_index("error", ":", 1).alias("error")),
        "loaded_images": lambda s, d: images.images(fixtures.pixmaps(s, d)).select("path", "width", "height", F.sha2("rgb", 256).alias("sha"), F.substring_index("error", ":", 1).alias("error")),
        "prepared_images": lambda s, d: I.prepare(images.images(fixtures.pixmaps(s, d)).where("error IS NULL"), "path").select("path", "width", "height", F.sha2("pixels", 256).alias("sha")),
        "read_pages": lambda s, d: _page_rows(distill.read_pages(fixtures.files(s, d), fixtures.STAND_INS)),
        "distill_cached": lambda s, d: _distill(s, d).select("path", "page_index", "cached", F.sha2("text", 256).alias("sha"), "distilled_tokens_est"),
        "scan_totals": lambda s, d: distill.scan_totals(_distill(s, d)),
        "tool_events": lambda s, d: files.events(fixtures.event_lines(s, d)).select("session_id", "tool_name", "file_path", "offset", activity.bucket(F.col("tool_name"), F.col("command")).alias("bucket")),
        "stream_tool_events": lambda s, d: drain(files.events(fixtures.event_lines(s, d, parquet_stream(s, f"{d}/activity_log.parquet", t(s, d, "activity_log").schema))), "append").select("session_id", "tool_name", "file_path", "offset", activity.bucket(F.col("tool_name"), F.col("command")).alias("bucket")),
        "boilerplate_lines": lambda s, d: boilerplate.find(_pages(s, d)),
        "boilerplate_strip": lambda s, d: boilerplate.strip_pages(_pages(s, d)).select("page_id", "text"),
        "boilerplate_manifest": lambda s, d: boilerplate.manifest(_pages(s, d)),
        "boilerplate_tally": lambda s, d: boilerplate.tallies(boilerplate.manifest(_pages(s, d))),
        "boilerplate_rendered": lambda s, d: boilerplate.rendered(_docs(s, d).select("doc_key", "text"), boilerplate.manifest(_pages(s, d))).select("doc_key", F.sha2("rendered_text", 256).alias("sha")),
        "chunk_text": lambda s, d: chunking.chunk(t(s, d, "documents")),
        "index_postings": lambda s, d: retrieval.postings(t(s, d, "chunks"), "chunk_id"),
        "term_stats": lambda s, d: _index(s, d).terms.select("term", "df", F.round("idf", 6).alias("idf")),
        "index_totals": lambda s, d: _index(s, d).totals.select("n", F.round("avgdl", 6).alias("avgdl")),
        "bm25_scores": lambda s, d: _scored(s, d).select("q", "doc", F.round("score", 6).alias("score")),
        "cosine_topk": lambda s, d: retrieval.cosine_top(_vectors(s, d), _asked(s, d), 10),
        "search_answers": lambda s, d: retrieval.answers(_best(s, d), t(s, d, "chunks")),
        "hybrid_topk": _hybrid,
        "index_tree": _indexed_tree,
        "runs_of_misses": lambda s, d: flows.new_runs(_distill(s, d), "read").select("doc_key", "source_path", "trigger", "page_count", "pages_native", "pages_ocr", "pages_vision", "status", F.substring_index("error", ":", 1).alias("error")),
        "file_results": lambda s, d: flows.file_results(_distill(s, d)).select("path", "cached", F.get_json_object("result", "$.page_count").cast("long").alias("page_count"), F.get_json_object("result", "$.figure_count").cast("long").alias("figures"), F.substring_index("error", ":", 1).alias("error")),
        "reindex_replace": lambda s, d: store.replace_source(t(s, d, "chunks"), _fresh(s, d)).select("chunk_id", "source_path", "chunk_index", T.text_tokens("text").alias("tokens")),
        "vectors_left": lambda s, d: store.drop_vectors(t(s, d, "chunk_embeddings"), store.replace_source(t(s, d, "chunks"), _fresh(s, d))).select("chunk_id", "model"),
        "compress_kind": lambda s, d: _logs(s, d).select("doc_id", compress.kind(F.col("text")).alias("kind")),
        "compress_repeats": lambda s, d: _logs(s, d).select("doc_id", F.array_join(compress.collapse_repeats(T.split_lines("text")), "\n").alias("out")),
        "compress_truncate": lambda s, d: _logs(s, d).select("doc_id", F.array_join(compress.truncate(T.split_lines("text")), "\n").alias("out")),
        "compress_generic": lambda s, d: _logs(s, d).select("doc_id", compress.compress(F.col("text"), F.lit("generic")).alias("out")),
        "compress_git_status": lambda s, d: t(s, d, "documents").where(compress.is_git_status(F.col("text"))).select("doc_id", compress.git_status(F.col("text")).alias("out")),
        "compress_pytest": lambda s, d: _log_text(s, d).select("l_suppkey", compress.compress(F.col("test")).alias("out")),
        "compress_install": lambda s, d: _log_text(s, d).select("l_suppkey", compress.compress(F.col("install")).alias("out")),
        "compress_auto": lambda s, d: _logs(s, d).select("doc_id", compress.compress(F.col("text")).alias("out")),
        "compress_stats": lambda s, d: _logs(s, d).select("doc_id", T.text_tokens("text").alias("before"), T.text_tokens(compress.compress(F.col("text"), F.lit("generic"))).alias("after")).withColumn("saved", compress.saved_percent(F.col("before"), F.col("after"))),
        "activity_buckets": lambda s, d: t(s, d, "activity_log").dropDuplicates(["seq"]).select("seq", activity.bucket(F.col("tool_name"), F.when(F.col("seq") % 3 == 0, F.lit("GIT push")).when(F.col("seq") % 3 == 1, F.lit("run pytest -q"))).alias("bucket")),
        "activity_window": lambda s, d: activity.windows(_events(s, d), 10).select("session_id", "seq", "recency"),
        "activity_counts": lambda s, d: activity.bucket_counts(_events(s, d)),
        "activity_mode": lambda s, d: activity.modes(_events(s, d)),
        "activity_retention": lambda s, d: activity.retained(_events(s, d)).select("seq"),
        "activity_recorded": lambda s, d: activity.recorded(_events(s, d), _calls(t(s, d, "session_reads"))).select("seq", "session_id", "tool_name", "bucket"),
        "stream_activity_recorded": _recording,
        "read_gate": lambda s, d: t(s, d, "chunks").select("chunk_id", sessions.intercepts(F.col("source_path"), F.lit(None), F.when(F.col("chunk_id") % 4 == 0, F.col("chunk_index")), F.lit(None)).alias("answered")),
        "rereads": lambda s, d: sessions.rereads(t(s, d, "session_reads")).select("id", "reread"),
        "read_response": lambda s, d: _decisions(s, d).where("decision = 'deny'").select("id", "branch", _told().alias("sha")),
        "read_decision": lambda s, d: _decisions(s, d).select("id", "decision", "branch", _told().alias("sha")),
        "stream_read_decision": _decision_stream,
        "expand": lambda s, d: sessions.expand(_cached(s, d), t(s, d, "distillations").where("id % 3 = 0").select((F.col("id") + F.when(F.col("id") % 2 == 0, 10_000_000).otherwise(0)).alias("handle"))).select("handle", "found", F.sha2("rendered_text", 256).alias("sha")),
        "cache_entry": lambda s, d: store.by_handle(t(s, d, "distillations"), 7).select("id", "source_path", "content_hash"),
        "response_json": lambda s, d: t(s, d, "nation").select("n_nationkey", sessions.response(F.col("n_name")).alias("json")),
        "large_doc_head": _large,
        "duplicate_paragraphs": lambda s, d: audit.duplicates(t(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")),
        "duplicate_places": lambda s, d: audit.places(t(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")).select("hash", "path", "i"),
        "orphan_files": lambda s, d: audit.orphans(_notes(s, d), _mentioning(s, d).unionByName(_notes(s, d))),
        "audit_report": lambda s, d: audit.report(t(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), "review", _notes(s, d)),
        "file_audit": lambda s, d: audit.files(t(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")),
        "cache_hits": lambda s, d: store.hits(t(s, d, "session_reads").dropDuplicates(["id"]).select("id", "content_hash"), t(s, d, "distillations")).select("id", "hit"),
        "cache_misses": lambda s, d: store.misses(t(s, d, "session_reads").dropDuplicates(["id"]).select("id", "content_hash"), t(s, d, "distillations")).select("id"),
        "cache_latest": lambda s, d: store.latest(t(s, d, "distillations").select("source_path", "id", "content_hash"), "source_path", "id"),
        "cache_list": lambda s, d: store.listing(t(s, d, "distillations")).select("id", "source_path"),
        "content_hash": lambda s, d: t(s, d, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha"), F.sha1(T.collapse_space("text").cast("binary")).alias("norm")),
        "pack_route": lambda s, d: pack.pack(_tree(s, d), exclude="*copy/*").select("path", "route", "tokens"),
        "pack_include": lambda s, d: pack.pack(_tree(s, d), include="*.md", patterns=(*pack.EXCLUDES, "data/", "!data/*/keep.md", "*1.md")).select("path"),
        "pack_sections": lambda s, d: pack.pack(_tree(s, d)).where("route = 'text'").select("path", pack.markdown_section(F.col("path"), F.col("text"), F.lit(False)).alias("md"), pack.xml_section(F.col("path"), F.col("text"), F.lit(False)).alias("xml")),
        "pack_head": lambda s, d: pack.head(pack.pack(_tree(s, d)).where("route = 'text'")),
        "pack_distilled": lambda s, d: _whole_pack(s, d).select("path", "route", "reason", "tokens", F.sha2("text", 256).alias("sha")),
        "pack_skipped": lambda s, d: pack.skipped(_whole_pack(s, d)),
        "pack_document": lambda s, d: pack.document(_whole_pack(s, d)).select("part", "path", F.sha2("section", 256).alias("sha")),
        "pack_document_xml": lambda s, d: pack.document(_whole_pack(s, d), "xml").select("part", "path", F.sha2("section", 256).alias("sha")),
        "path_sort": lambda s, d: pack.by_path(t(s, d, "chunks").select(F.col("source_path").alias("path")).distinct()),
        "stream_activity_mode": lambda s, d: _stream_modes(s, d),
        "stream_rereads": lambda s, d: drain(streams.reread_stream(parquet_stream(s, f"{d}/session_reads.parquet", t(s, d, "session_reads").schema)), "append").select("id", "reread"),
    }
    return q


def _stream_modes(s: SparkSession, d: str) -> DataFrame:
    schema = table(s, d, "activity_log").schema
    b = F.regexp_replace(F.lower(F.regexp_replace("bucket", r"[\s_-]", "")), "^bash(test|git|infra)$", "bash_$1")
    stream = parquet_stream(s, f"{d}/activity_log.parquet", schema).withColumn("bucket", b)
    return store.latest(drain(streams.rolling_modes(stream), "update"), "session_id", "epoch").select("session_id", "n", "mode")
