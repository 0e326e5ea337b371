"""Driving a stream over files to its end, for replays and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ctxlake.runtime import is_folder, new_folder


def parquet_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of a folder of Parquet files, or of one file: its folder with a name filter, as a stream's source is a folder. The file system
    itself says which of the two it is, be it local or remote."""
    path = path.rstrip("/")
    if is_folder(spark, path):
        return spark.readStream.schema(schema).parquet(path)
    parent, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run over all that is there now, write each micro-batch to the shared folder, and read that back."""
    spark = stream.sparkSession
    where = new_folder(spark, "stream")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(f"{where}/out")
