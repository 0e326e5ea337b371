"""The operators put together: an index of a tree kept in versions, questions to it, results and run-log rows of files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlake.backends import Backends
from ctxlake.config import DEFAULT, EngineConfig
from ctxlake.operators import chunking, distill, pack, pages, retrieval, store
from ctxlake.runtime import hadoop_path, is_folder

VECTORS = "chunk_id long, model string, vector array<float>, error string"


@dataclass(frozen=True)
class Version:
    """One state of an index: chunks, their vectors (with the reason where one is missing), keyword index."""

    number: int
    chunks: DataFrame
    vectors: DataFrame
    index: retrieval.Index


def _numbers(spark: SparkSession, root: str) -> list[int]:
    if not is_folder(spark, root):
        return []
    p, fs = hadoop_path(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def current(spark: SparkSession, root: str) -> Version | None:
    """The newest version that is complete: the table of terms is written last, and a broken run leaves its version without it."""
    for n in reversed(_numbers(spark, root)):
        p, fs = hadoop_path(spark, f"{root}/v{n}/index/terms/_SUCCESS")
        if fs.exists(p):
            at = f"{root}/v{n}"
            return Version(n, spark.read.parquet(f"{at}/chunks"), spark.read.parquet(f"{at}/vectors"), retrieval.opened(spark, f"{at}/index"))
    return None


def index_tree(files: DataFrame, root: str, backends: Backends | None = None, model: str = "", distilled: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> Version:
    """Pack a tree (path, content), cut it into chunks and write the next version under ``root``: chunks of the files seen again are replaced with their vectors, those
    of other files stay. Without an embedding service, or where it fails, the keyword index stands alone."""
    spark, old = files.sparkSession, current(files.sparkSession, root)
    packed = pack.pack(files, distilled=distilled, cfg=cfg)
    n = max(_numbers(spark, root), default=0) + 1
    at = f"{root}/v{n}"
    fresh = chunking.chunk_rows(packed, cfg)
    if old is not None:
        seen = packed.where("route <> 'skip'").select(F.col("path").alias("source_path"))
        fresh = old.chunks.join(seen, "source_path", "left_anti").select(*fresh.columns).unionByName(fresh)
    fresh.write.mode("overwrite").parquet(f"{at}/chunks")
    chunks = spark.read.parquet(f"{at}/chunks")
    kept = None if old is None else store.drop_vectors(old.vectors.where("error IS NULL"), chunks.join(old.chunks.select("chunk_id", "indexed_at"), ["chunk_id", "indexed_at"], "left_semi"))
    if backends is not None and backends.embed is not None:
        todo = chunks if kept is None else chunks.join(kept.select("chunk_id"), "chunk_id", "left_anti")
        new = chunking.embedded(todo, backends, model)
        vectors = new if kept is None else kept.unionByName(new)
    else:
        vectors = kept if kept is not None else spark.createDataFrame([], VECTORS)
    vectors.write.mode("overwrite").parquet(f"{at}/vectors")
    retrieval.build(chunks, "chunk_id", f"{at}/index")
    return current(spark, root)


def ask(version: Version, questions: DataFrame, k: int = DEFAULT.top_k, backends: Backends | None = None, model: str = "") -> DataFrame:
    """q, rank, doc, score, source_path, chunk_index, preview: the k best chunks of each question (q, question); keyword scores, blended with cosines where there are
    vectors and a service that embeds the questions."""
    scored = retrieval.normalised(retrieval.scores(version.index, questions), questions)
    if backends is not None and backends.embed is not None:
        asked = chunking.embedded(questions.select(F.col("q").alias("chunk_id"), F.col("question").alias("text")), backends, model, "query").where("error IS NULL")
        asked = asked.select(F.col("chunk_id").alias("q"), "model", F.col("vector").alias("qv"))
        vectors = version.vectors.where("error IS NULL").select(F.col("chunk_id").alias("doc"), "model", "vector")
        scored = retrieval.blend(scored, retrieval.cosines(vectors, asked))
    best = retrieval.top_k(scored, version.index.lengths, questions, k)
    return retrieval.answers(best, version.chunks)


def file_results(distilled: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """content_hash, path, error, cached, result (JSON of 13 fields; null where the file could not be read) of the pages that distill() gave."""
    docs = distill.results(distilled, cfg).withColumn("source_path", F.col("path")).withColumn("duration_ms", F.lit(None).cast("long"))
    cached = distilled.groupBy("content_hash").agg(F.bool_and(F.coalesce("cached", F.lit(False))).alias("cached"))
    return docs.withColumn("result", F.when(F.col("error").isNull(), pages.result_json())).join(cached, "content_hash").select("content_hash", "path", "error", "cached", "result")


def new_runs(distilled: DataFrame, trigger: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Rows of the run log: only files that were not in the cache, and those that failed."""
    fresh = distilled.where("NOT coalesce(cached, false)")
    docs = distill.results(fresh, cfg).where("error IS NULL").withColumn("doc_key", F.col("content_hash")).withColumn("source_path", F.col("path"))
    return pages.run_rows(docs, trigger).unionByName(pages.failed_runs(fresh, trigger), allowMissingColumns=True)
