"""Problem 3: collapse runs of identical or near-identical consecutive events.

Method: a sorted streaming state machine. Events are range-partitioned by (session, ts, seq), so one session may spread
over any number of tasks; each task walks its sorted slice once, comparing each event with the anchor (first event) of
the open run. A run that touches an edge of its slice stays provisional; a second pass of the same state machine over
only these edge rows, in the same plan, joins what a slice border cut.

Where near-identical events join a run, the anchor that comes from the slice before matters. A slice therefore follows every anchor that is
possible (at first all keys of the table): an event similar to some of them leaves these and, if it is not similar to all, its own key. Once an event is
similar to none of them, a run begins there whatever came before, and only what precedes it is left to the second pass, as runs of equal keys. A
table of more than KEYS different keys leaves doubt until the first gap instead.

Defined results: rows with a null session, bucket, ts or seq, or a bucket without letters, take no part; rows with
the same seq are one event (the least by ts, session, bucket); equal ts are ordered by seq; an empty table gives no
rows; columns other than the four named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlake.runtime import shuffle_partitions

SCHEMA = "session_id string, key string, first_us long, first_seq long, last_us long, last_seq long, n_events long, edge int"
#: edge: 0 a finished run; 1 it may go on from the slice before and into the next; 2 it starts in its slice and may go on into the next.
_ARROW = pa.schema(
    [("session_id", pa.string()), ("key", pa.string()), ("first_us", pa.int64()), ("first_seq", pa.int64()), ("last_us", pa.int64()), ("last_seq", pa.int64()), ("n_events", pa.int64()), ("edge", pa.int32())]
)


@lru_cache(maxsize=65536)
def similarity(a: str, b: str) -> float:
    """Dice similarity of character pairs; 1.0 only for equal keys."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} or {s} for s in (a, b))
    return min(2 * len(x & y) / (len(x) + len(y)), 0.999999)


#: Different keys that a slice follows as possible anchors.
KEYS = 5000


class RunMachine:
    """State: the open run, kept under its anchor's key. ``feed`` gives the run that an event closes, if any."""

    def __init__(self, gap_us: int, least: float):
        self.gap_us, self.least, self.run = gap_us, least, None

    def joins(self, session: str, key: str, us: int) -> bool:
        r = self.run
        if r is None or r[0] != session or us - r[4] > self.gap_us:
            return False
        return r[1] == key or (self.least < 1.0 and similarity(r[1], key) >= self.least)

    def feed(self, session, key, f_us, f_seq, l_us, l_seq, n):
        if self.joins(session, key, f_us):
            r = self.run
            r[4], r[5], r[6] = l_us, l_seq, r[6] + n
            return None
        done, self.run = self.run, [session, key, f_us, f_seq, l_us, l_seq, n]
        return done


def _columns(rows: list[list], edge: list[int]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip([*cols, edge], _ARROW)], schema=_ARROW)


def _first_pass(gap_us: int, least: float, keys: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, prev = RunMachine(gap_us, least), None
        # With exact keys the second run of a slice no longer depends on what came before; with a similarity it does until
        # a session, a gap or an event unlike all possible anchors ends all doubt.
        anchor_known, anchors = False, keys
        for b in batches:
            out, edge = [], []
            for s, k, us, seq in zip(*(b.column(i).to_pylist() for i in range(4))):
                if not anchor_known:
                    ends = prev is not None and (prev[0] != s or us - prev[2] > gap_us)
                    if not ends and least >= 1.0:
                        ends = prev is not None and prev[1] != k
                    elif not ends and anchors is not None:
                        like = {a for a in anchors if similarity(a, k) >= least}
                        ends = not like and prev is not None
                        anchors = like if len(like) == len(anchors) else like | {k}
                    if ends or (prev is not None and m.run and m.run[1] != k):
                        out.append(m.run)  # while in doubt: hand on runs of equal keys only
                        edge.append(1)
                        m.run, anchor_known = None, ends
                if (done := m.feed(s, k, us, seq, us, seq, 1)) is not None:
                    out.append(done)
                    edge.append(0)
                prev = (s, k, us)
            if out:
                yield _columns(out, edge)
        if m.run is not None:
            yield _columns([m.run], [2 if anchor_known else 1])

    return run


def _second_pass(gap_us: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = RunMachine(gap_us, least)
        for b in batches:
            d = b.to_pydict()
            out = []
            for s, k, fu, fs, lu, ls, n, e in zip(*(d[f.name] for f in _ARROW)):
                if e == 2 and m.run is not None:
                    out.append(m.run)
                    m.run = None
                done = m.feed(s, k, fu, fs, lu, ls, n) if e else [s, k, fu, fs, lu, ls, n]
                if done is not None:
                    out.append(done)
            if out:
                yield _columns(out, [0] * len(out))
        if m.run is not None:
            yield _columns([m.run], [0])

    return run


def collapse_runs(
    events: DataFrame, session: str = "session_id", bucket: str = "bucket", ts: str = "ts", seq: str = "seq", gap_seconds: float = 600.0, min_similarity: float = 1.0, min_events: int = 1
) -> DataFrame:
    """One row per run: session_id, bucket (its letters, lower case), first_seq, last_seq, first_ts, last_ts, n_events,
    duration_s. ``min_events`` drops shorter finished runs."""
    gap_us, n = round(gap_seconds * 1e6), shuffle_partitions(events)
    key = F.lower(F.regexp_replace(F.col(bucket), r"\P{L}+", ""))
    e = events.select(
        F.col(session).cast("string").alias("session_id"), key.alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(seq).cast("long").alias("seq")
    ).where("session_id IS NOT NULL AND key <> '' AND us IS NOT NULL AND seq IS NOT NULL")
    e = e.groupBy("seq").agg(F.min(F.struct("us", "session_id", "key")).alias("e")).select("e.session_id", "e.key", "e.us", "seq")
    keys = None
    if min_similarity < 1.0:  # normalised bucket names: few, and no more than KEYS + 1 reach the driver
        some = e.select("key").distinct().limit(KEYS + 1).collect()
        keys = frozenset(r.key for r in some) if len(some) <= KEYS else None
    first = e.repartitionByRange(n, "session_id", "us", "seq").sortWithinPartitions("session_id", "us", "seq").mapInArrow(_first_pass(gap_us, min_similarity, keys), SCHEMA)
    # Edge rows go to one task: two a slice for exact keys, a few more for similar ones. Finished runs only pass through, spread over the rest.
    first = first.where((F.col("edge") > 0) | (F.col("n_events") >= min_events))
    spread = F.when(F.col("edge") > 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("first_seq"), F.lit(max(1, n - 1))) + 1)
    runs = first.repartition(n, spread).sortWithinPartitions("session_id", "first_us", "first_seq").mapInArrow(_second_pass(gap_us, min_similarity), SCHEMA)
    return runs.where(F.col("n_events") >= min_events).select(
        "session_id",
        F.col("key").alias("bucket"),
        "first_seq",
        "last_seq",
        F.timestamp_micros("first_us").alias("first_ts"),
        F.timestamp_micros("last_us").alias("last_ts"),
        "n_events",
        ((F.col("last_us") - F.col("first_us")) / F.lit(1e6)).alias("duration_s"),
    )
