"""The same results as in batch, kept up to date by Structured Streaming with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ctxlake.config import DEFAULT, EngineConfig
from ctxlake.operators import activity, sessions
from ctxlake.operators.activity import mode
from ctxlake.runtime import hadoop_path


def _ring(n: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        for b in batches:
            kept = sorted({*kept, *zip(b.seq.tolist(), b.bucket.fillna("").tolist())}, reverse=True)[:n]
        state.update(([k[0] for k in kept], [k[1] for k in kept]))
        yield pd.DataFrame({"session_id": [key[0]], "buckets": [[k[1] for k in kept]], "last_seq": [kept[0][0]]})

    return update


def rolling_modes(events: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """From a stream (session_id, seq, bucket): session_id, n, mode, last_seq after each micro-batch. The state of a session is its last few
    events, in whatever order they arrive."""
    e = events.where("session_id IS NOT NULL AND seq IS NOT NULL").select("session_id", "seq", "bucket")
    r = e.groupBy("session_id").applyInPandasWithState(_ring(cfg.activity_window), "session_id string, buckets array<string>, last_seq long", "seqs array<long>, buckets array<string>", "update", GroupStateTimeout.NoTimeout)
    of = lambda b: F.size(F.filter("buckets", lambda x: x == b))
    n = F.size("buckets")
    return r.select("session_id", n.cast("long").alias("n"), mode(n, of("edit"), of("read"), of("bash_test"), of("bash_git"), of("bash_infra")).alias("mode"), "last_seq")


#: How long the id of a read is kept, to know it when it is delivered again.
KEPT_US = 24 * 3600 * 1_000_000


def _first(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ids, times, first = state.get if state.exists else ([], [], None)
    seen = dict(zip(ids, times))
    for b in batches:
        b = b[~b.id.isin(list(seen))].drop_duplicates("id").sort_values(["seen_at", "id"])
        if len(b):
            if first is None:
                first = int(b.id.iloc[0])
            seen.update(zip(b.id.tolist(), (b.seen_at.astype("datetime64[us]").astype("int64")).tolist()))
            yield pd.DataFrame({"id": b.id, "session_id": key[0], "content_hash": key[1], "reread": b.id != first})
    newest = max(seen.values(), default=0)
    seen = {i: t for i, t in seen.items() if t >= newest - KEPT_US}
    state.update((list(seen), list(seen.values()), first))


def reread_stream(reads: DataFrame) -> DataFrame:
    """From a stream (id, session_id, content_hash, seen_at): id, session_id, content_hash, reread. A read is a repetition if its session had the content
    in an earlier micro-batch, or earlier in this one; reads without a session are kept out of the state. The state of a session and content is its
    first id and the ids of its last day, so a row delivered again within a day counts once."""
    r = reads.where("session_id IS NOT NULL AND seen_at IS NOT NULL").select("id", "session_id", "content_hash", "seen_at")
    return r.groupBy("session_id", "content_hash").applyInPandasWithState(_first, "id long, session_id string, content_hash string, reread boolean", "ids array<long>, times array<long>, first long", "append", GroupStateTimeout.NoTimeout)


def decision_stream(reads: DataFrame, shown: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """sessions.decisions() of a stream of reads, joined with the table of cached documents: id, decision, branch, response. Reads without a session are never
    repetitions; those that pass, whatever the reason, go by untouched."""
    g = sessions.gated(reads, shown, cfg)
    asked = g.where("gate IS NULL")
    known = reread_stream(asked).select("id", "content_hash", "reread")
    free = asked.where("session_id IS NULL OR seen_at IS NULL").select("id", "content_hash", F.lit(False).alias("reread"))
    return sessions.answered(known.unionByName(free), shown, cfg).unionByName(sessions.passed(g))


def recording(calls: DataFrame, folder: str, log: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> StreamingQuery:
    """Write a stream of tool calls (session_id, ts, tool_name, command) to a log that keeps the newest events only: after each micro-batch the log, at most
    activity_keep rows, is a new version under ``folder``. ``log``: what it begins with. A batch that is repeated after a failure writes its version again."""
    spark = calls.sparkSession
    empty = "seq long, session_id string, ts timestamp, tool_name string, bucket string"
    first = activity.retained(log.select("seq", "session_id", "ts", "tool_name", "bucket"), cfg) if log is not None else spark.createDataFrame([], empty)
    first.coalesce(1).write.mode("overwrite").parquet(f"{folder}/log/v0")

    def write(batch: DataFrame, epoch: int) -> None:
        before = batch.sparkSession.read.parquet(f"{folder}/log/v{epoch}")
        activity.recorded(before, batch, cfg).coalesce(1).write.mode("overwrite").parquet(f"{folder}/log/v{epoch + 1}")

    return calls.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def recorded_log(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of the log that was written to its end."""
    p, fs = hadoop_path(spark, f"{folder}/log/v*/_SUCCESS")
    n = max(int(x.getPath().getParent().getName()[1:]) for x in fs.globStatus(p))
    return spark.read.parquet(f"{folder}/log/v{n}")


def events_per_window(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: events by bucket in event-time windows, with a watermark; rows delivered twice within it count once."""
    e = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq"])
    return e.groupBy(F.window("ts", width), "bucket").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "bucket", "n")
