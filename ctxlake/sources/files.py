"""Scans of folders and of event streams."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlake.config import DEFAULT, EngineConfig
from ctxlake.operators.sessions import suffix
from ctxlake.runtime import hadoop_path

EVENT = "session_id string, tool_name string, tool_input struct<file_path:string,pages:string,offset:int,limit:int,command:string>"


def _opened(path: str):
    """The file system of a path or URI, and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file" or "/" in scheme:
        return LocalFileSystem(), "/" + (rest if colon and "/" not in scheme else path).lstrip("/")
    return FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def _listed(root: str):
    """Paths, relative to ``root``, of the files at and under the entries of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(root)
        base = base.rstrip("/")
        for b in batches:
            for entry in b.column(0).to_pylist():
                at = fs.get_file_info(f"{base}/{entry}")
                found = [at] if at.is_file else fs.get_file_info(FileSelector(at.path, recursive=True))
                yield pa.RecordBatch.from_arrays([pa.array([x.path[len(base) + 1 :] for x in found if x.is_file], pa.string())], names=["path"])

    return run


def _contents(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(root)
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], names=["path", "content"])

    return run


def tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file under a folder: path relative to it, content. Spark's own scan leaves out empty files and names that begin with a dot or an underscore (as
    __init__.py does), so the folders are listed in tasks, one for each entry of the root, and the files spread by their names before they are read."""
    fs, base = _opened(root)
    entries = [(x.base_name,) for x in fs.get_file_info(FileSelector(base.rstrip("/") or "/"))]
    if not entries:
        return spark.createDataFrame([], "path string, content binary")
    rows = spark.createDataFrame(entries, "entry string").repartition(min(len(entries), 4 * spark.sparkContext.defaultParallelism))
    return rows.mapInArrow(_listed(root), "path string").repartition("path").mapInArrow(_contents(root), "path string, content binary")


def distillable(spark: SparkSession, root: str, recursive: bool = False, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """PDF and image files of a folder with the hash of their content."""
    f = tree(spark, root).where(suffix(F.col("path")).isin(*cfg.distillable))
    f = f if recursive else f.where(~F.col("path").contains("/"))
    return f.withColumn("content_hash", F.sha2("content", 256))


def ignore_file(spark: SparkSession, root: str, name: str = ".gitignore") -> str | None:
    """The text of the root's ignore file, of any file system; None without one."""
    p, fs = hadoop_path(spark, f"{root.rstrip('/')}/{name}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def ignore_rules(text: str | None, defaults: tuple[str, ...]) -> tuple[str, ...]:
    """The default rules and those of the root's ignore file."""
    return (*defaults, *(text or "").splitlines())


def events(stream: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines of tool calls as columns; a broken line gives nulls."""
    return stream.select(F.from_json(column, EVENT).alias("e")).select("e.session_id", "e.tool_name", "e.tool_input.*")
