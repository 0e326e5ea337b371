"""Session helpers: reading tables, cutting lineage in the shared checkpoint folder, choosing partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[8]", partitions: int = 8, app: str = "ctxlake", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share. Only where all runs in one process (a local master, as in tests) one
    is made where none is named; a cluster without it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("ctxlake.local.folder", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="ctxlake-")
        discard_at_exit(spark, where)
        spark.conf.set("ctxlake.local.folder", where)
    return where.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, of whatever kind."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def discard_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the driver ends."""
    p, fs = hadoop_path(spark, path)
    fs.deleteOnExit(p)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path under the shared folder that nobody uses, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    p, fs = hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a lost executor costs nothing and nothing upstream runs twice. Spark deletes the files
    when nobody refers to them any more, if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like checkpointed(), for tables that are read by column or filter. Deleted when the driver ends."""
    path = new_folder(df.sparkSession, "table")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sample_by_hash(df: DataFrame, n: int, most: int, *ids: str) -> DataFrame:
    """At most ``most`` of the ``n`` rows, the same ones each time, by a hash of ``ids``. A filter leaves about one and a half times as many before
    they are ordered, so what tasks send to the driver does not grow with their number."""
    part = min(1.0, 1.5 * most / max(n, 1) + 100 / max(n, 1))
    h = F.xxhash64(*ids)
    return df.where(F.pmod(h, F.lit(1 << 40)) < int(part * (1 << 40))).orderBy(h, *ids).limit(most)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan gives far fewer partitions, as one small file does; large inputs stay as they are read. Where there is a
    shuffle already, nothing is done: asking an adaptive plan for its partitions would run it."""
    if df._jdf.queryExecution().executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
