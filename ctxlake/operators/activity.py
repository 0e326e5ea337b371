"""Session activity: bucket of a tool call, mode of a session from its last events, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ctxlake.config import DEFAULT, EngineConfig

#: Commands that run tests (fixed values).
TEST_MARKERS = ("pytest", "npm test", "npm run test", "go test", "jest", "cargo test", "mvn test")


def bucket(tool: Column, command: Column) -> Column:
    c = F.lower(F.coalesce(command, F.lit("")))
    test = F.lit(False)
    for m in TEST_MARKERS:
        test = test | c.contains(m)
    shell = F.when(test, "bash_test").when(c.startswith("git ") | c.contains(" git "), "bash_git").otherwise("bash_infra")
    return F.when(tool.isin("Edit", "Write", "NotebookEdit"), "edit").when(tool.isin("Read", "Glob", "Grep"), "read").when(tool == "Bash", shell).when(tool.isin("WebFetch", "WebSearch"), "web").otherwise("other")


def mode(n: Column, edit: Column, read: Column, test: Column, git: Column, infra: Column) -> Column:
    """First rule that holds: nothing seen; tests and edits; edits; reads without edits; shell work."""
    return (
        F.when(n == 0, "general")
        .when((test >= 2) & (edit >= 1), "debug")
        .when(edit >= F.greatest(F.lit(1), F.floor(n / 3)), "code")
        .when((read >= F.greatest(F.lit(1), F.floor(n * F.lit(0.6)))) & (edit == 0), "review")
        .when(infra + git >= F.greatest(F.lit(1), F.floor(n * F.lit(0.5))), "infra")
        .otherwise("general")
    )


def recent(events: DataFrame, n: int, by: str = "session_id", order: str = "seq") -> DataFrame:
    """The last n events of each session, newest first. Each task first cuts its own share down (a salted rank), so a hot session is never
    gathered in one task."""
    salted = W.Window.partitionBy(by, F.pmod(F.xxhash64(order), F.lit(64))).orderBy(F.desc(order))
    few = events.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= n).drop("_r")
    w = W.Window.partitionBy(by).orderBy(F.desc(order))
    return few.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def windows(events: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The last n events of each session, and, with a null session_id, those of all sessions together: the window of a reader who names no session. That
    one is a top-k, cut down in every task."""
    by_session = recent(events.where("session_id IS NOT NULL"), n, order=order)
    last = events.withColumn("session_id", F.lit(None).cast("string")).orderBy(F.desc(order)).limit(n)
    return by_session.unionByName(last.withColumn("recency", F.row_number().over(W.Window.partitionBy("session_id").orderBy(F.desc(order)))))  # n rows


def modes(events: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """session_id (null for all sessions together), n, mode."""
    of = lambda b: F.count_if(F.col("bucket") == b)
    g = windows(events, cfg.activity_window).groupBy("session_id").agg(F.count("*").alias("n"), of("edit").alias("e"), of("read").alias("r"), of("bash_test").alias("t"), of("bash_git").alias("g"), of("bash_infra").alias("i"))
    return g.select("session_id", "n", mode(F.col("n"), F.col("e"), F.col("r"), F.col("t"), F.col("g"), F.col("i")).alias("mode"))


def bucket_counts(events: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return windows(events, cfg.activity_window).groupBy("session_id", "bucket").agg(F.count("*").alias("n"))


def retained(events: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The newest events over all sessions: a top-k, no full sort."""
    return events.orderBy(F.desc("seq")).limit(cfg.activity_keep)


_ORDER = ("ts", "tool_name", "session_id", "command")


def recorded(log: DataFrame, new: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The log after ``new`` (session_id, ts, tool_name, command, in the order of ts) came in: seq goes on from the log's greatest, the bucket is set, and only the
    newest events stay. New events beyond what stays are cut off first, so numbering them takes no sort of all."""
    last = new.orderBy(*(F.desc(c) for c in _ORDER)).limit(cfg.activity_keep)
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"))
    out = new.agg(F.greatest(F.count("*") - cfg.activity_keep, F.lit(0)).alias("out"))  # those cut off take their numbers too
    w = W.Window.partitionBy(F.lit(0)).orderBy(*_ORDER)  # at most activity_keep rows
    n = last.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(out)).withColumn("seq", F.col("top") + F.col("out") + F.row_number().over(w))  # one row each
    n = n.select("seq", "session_id", "ts", "tool_name", bucket(F.col("tool_name"), F.col("command")).alias("bucket"))
    return retained(log.select("seq", "session_id", "ts", "tool_name", "bucket").unionByName(n), cfg)
