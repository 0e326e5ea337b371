"""Tables kept on Parquet without row updates: latest row wins, replacement by source, cache lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key: an aggregation with partial sums, not a sort of each group."""
    others = [c for c in rows.columns if c not in (key, order)]
    m = rows.groupBy(key).agg(F.max(F.col(order)).alias(order), F.max_by(F.struct(*others), F.col(order)).alias("_r"))
    return m.select(key, order, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*rows.columns)


def hits(files: DataFrame, cache: DataFrame, key: str = "content_hash") -> DataFrame:
    """The files with hit: whether the cache holds their content."""
    have = cache.select(key).distinct().withColumn("hit", F.lit(True))
    return files.join(have, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(files: DataFrame, cache: DataFrame, key: str = "content_hash") -> DataFrame:
    return files.join(cache.select(key), key, "left_anti")


def replace_source(chunks: DataFrame, fresh: DataFrame, source: str = "source_path") -> DataFrame:
    """The chunks with those of every source in ``fresh`` replaced."""
    return chunks.join(fresh.select(source).distinct(), source, "left_anti").unionByName(fresh)


def drop_vectors(vectors: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The vectors whose chunk still exists."""
    return vectors.join(chunks.select(key), key, "left_semi")


def listing(cache: DataFrame, n: int = 50, handle: str = "id") -> DataFrame:
    return cache.orderBy(F.desc(handle)).limit(n)


def by_handle(cache: DataFrame, handle: int, key: str = "id") -> DataFrame:
    """The cached row of one handle, or none."""
    return cache.where(F.col(key) == handle)
