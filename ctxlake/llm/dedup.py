"""Problem 1: groups of records that are nearly the same.

Method: HyperMinHash. The shingles of a record are hashed into buckets by FAMILIES independent hash functions; each
bucket keeps the least value as a register of 6 bits for its leading zeros and 10 bits of mantissa. Four registers make
a band; records that share a band are candidates. The part of equal registers, corrected for the chance collisions of
compressed registers, estimates the Jaccard similarity; candidates too far below the threshold go, the rest are verified exactly.

Copies (records with one set of shingles) are one class throughout; only its least id is compared with others, so a hot
group of copies is one row after partial aggregation. Bands are gathered by key; of a band that a hash sample of the records shows to be large,
the records go in blocks to units of two blocks each, which give only pairs that pass the estimate. Sets of shingles are made for candidates only. Groups are the connected components of the links, by repeated exchange of least ids.

Defined results: null texts and texts of fewer than ``min_words`` words take no part; a word is a longest run of letters
and digits, in lower case; rows with the same id are compared as separate members but never paired with themselves;
an empty table gives no rows; other columns are ignored. The bands find a pair at the threshold of 0.5 with a
probability of 0.955, one at 0.6 with 0.999. Sets hold 64 bits of a shingle's hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlake.runtime import checkpointed, saved, shuffle_partitions, spread

WORD = re.compile(r"[^\W_]+")
FAMILIES, BUCKETS, BAND = 12, 16, 4
MANTISSA = 10
#: Registers that go along for the estimate: those of the first families.
ESTIMATE = 4 * BUCKETS
#: A band is large if this many of one in SAMPLE_OF records (by a hash) are in it; it is cut into blocks of about BLOCK records.
SAMPLE_OF, MANY, BLOCK = 16, 12, 256
#: Large bands, and ids of candidates, that are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000
U = np.uint64
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, (FAMILIES, 2), dtype=np.uint64) | U(1)


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        h = self[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_WORDS = _Hashes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def shingles(texts: list[str | None], size: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with enough words, hashes of all their shingles one after another, and where each row's shingles begin (and the end)."""
    if len(_WORDS) > 1_000_000:
        _WORDS.clear()
    least = max(min_words, size)
    rows, hashes, begin = [], [], [0]
    for r, t in enumerate(texts):
        words = WORD.findall(t.lower()) if t else ()
        if len(words) >= least:
            w = np.fromiter(map(_WORDS.__getitem__, words), U, len(words))
            n = len(words) - size + 1
            s = np.zeros(n, U)
            for i in range(size):
                s = s * U(0x100000001B3) + (w[i : i + n] ^ (w[i : i + n] >> U(7)))
            rows.append(r)
            hashes.append(s)
            begin.append(begin[-1] + n)
    return np.array(rows, np.int64), mix(np.concatenate(hashes)) if hashes else np.zeros(0, U), np.array(begin)


def registers(h: np.ndarray, begin: np.ndarray, families: int = FAMILIES) -> np.ndarray:
    """uint16 [rows, families * BUCKETS]. An empty bucket borrows from the next full one of its family."""
    n = len(begin) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(begin))
    out = np.empty((n, families, BUCKETS), np.uint16)
    for f in range(families):
        x = (h ^ _SEEDS[f, 0]) * _SEEDS[f, 1]
        x ^= x >> U(32)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(29)
        least = np.full(n * BUCKETS, np.iinfo(np.uint64).max, U)
        np.minimum.at(least, owner + (x & U(BUCKETS - 1)).astype(np.int64), x >> U(4))
        least = least.reshape(n, BUCKETS)
        empty = least == np.iinfo(np.uint64).max
        m, e = np.frexp(least.astype(np.float64))
        reg = (np.clip(60 - e, 0, 63).astype(np.uint16) << MANTISSA) | np.minimum((m * 2 - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).astype(np.uint16)
        done, filled = reg.copy(), ~empty
        for step in range(1, BUCKETS):
            if filled.all():
                break
            from_, ok = np.roll(reg, -step, 1), np.roll(~empty, -step, 1)
            take = ~filled & ok
            done[take] = from_[take] * np.uint16(31) + np.uint16(step)
            filled |= take
        out[:, f] = done
    return out.reshape(n, families * BUCKETS)


def band_keys(reg: np.ndarray) -> np.ndarray:
    """int32 [rows, bands]: each band has one register of each of four families."""
    r = reg.reshape(len(reg), FAMILIES // BAND, BAND, BUCKETS).astype(U)
    key = (r[:, :, 0] << U(48)) | (r[:, :, 1] << U(32)) | (r[:, :, 2] << U(16)) | r[:, :, 3]
    key = key.reshape(len(reg), -1)
    return (mix(key) >> U(32)).astype(np.uint32).view(np.int32)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the part of equal registers, less the expected part of collisions (HyperMinHash)."""
    equal = (a == b).mean(1)
    big, small = np.maximum(na, nb).astype(float), np.minimum(na, nb).astype(float)
    ratio = big / np.maximum(small, 1)
    c = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip((equal - c) / (1 - c), 0, 1)


def _banding(size: int, min_words: int):
    """gid, print (two hashes of the set of shingles), keys of the bands, sketch, number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, h, begin = shingles(b.column(1).to_pylist(), size, min_words)
            if len(rows):
                at, part = pa.array(rows), b.column(2).take(pa.array(rows)).to_numpy()
                reg = registers(h, begin)
                keys = band_keys(reg) ^ (mix(part.astype(U)) >> U(32)).astype(np.uint32).view(np.int32)[:, None]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                prints = [blake2b(np.unique(h[lo:hi]).tobytes(), digest_size=16, key=p.tobytes()).digest() for p, lo, hi in zip(part, begin, begin[1:])]
                prints = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
                sketch = pa.array([r.tobytes() for r in reg[:, :ESTIMATE]], pa.binary())
                cols = [b.column(0).take(at), pa.array(prints[:, 0]), pa.array(prints[:, 1]), flat, sketch, pa.array(np.diff(begin), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["gid", "p1", "p2", "keys", "sketch", "n"])

    return run


def _sets(size: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, h, begin = shingles(b.column(1).to_pylist(), size, min_words)
            if len(rows):
                sets = [np.unique(h[lo:hi]).tobytes() for lo, hi in zip(begin, begin[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(sets, pa.binary())], names=["gid", "set"])

    return run


def _estimating(least: float):
    """Keeps the pairs (a, b, ra, rb, na, nb) whose estimate is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(b.num_rows, -1) for i in (2, 3))
                near = pa.array(np.flatnonzero(estimate(x, y, np.asarray(b.column(4)), np.asarray(b.column(5))) >= least))
                yield pa.RecordBatch.from_arrays([b.column(0).take(near), b.column(1).take(near)], names=["a", "b"])

    return run


def _blocks(least: float):
    """Pairs (a, b) whose estimate is at least ``least``, of units (key, i, j) whose rows (key, i, j, block, rep, sketch, n) come one unit after another."""

    def pairs(i: int, j: int, rows: list) -> pa.RecordBatch:
        x = [r for r in rows if r[0] == i]
        y = x if i == j else [r for r in rows if r[0] == j]
        out: list[list[int]] = [[], []]
        if x and y:
            others, n = np.array([r[1] for r in y]), np.array([r[3] for r in y])
            base = np.frombuffer(b"".join(r[2] for r in y), np.uint16).reshape(len(y), -1)
            for r in x:
                near = estimate(np.frombuffer(r[2], np.uint16)[None], base, np.array([r[3]]), n) >= least
                found = others[near & (others > r[1] if i == j else others != r[1])]
                out[0] += np.minimum(found, r[1]).tolist()
                out[1] += np.maximum(found, r[1]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for b in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (key, i, j) != unit:
                    if rows:
                        yield pairs(*unit[1:], rows)
                    unit, rows = (key, i, j), []
                rows.append(row)
        if rows:
            yield pairs(*unit[1:], rows)

    return run


def _verifying(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sim = [], []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                u, v = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                j = both / (len(u) + len(v) - both)
                if j >= threshold:
                    keep.append(i)
                    sim.append(j)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _candidates(reps: DataFrame, least: float, sample_of: int, many: int, block: int) -> DataFrame:
    """Pairs (a, b), a < b, of representatives (rep, keys, sketch, n) that share a band; of large bands only those that pass the estimate."""
    bands = reps.select("rep", F.posexplode("keys").alias("band", "k")).select("rep", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("k")).alias("key"))
    some = bands.where(F.pmod(F.xxhash64("rep"), F.lit(sample_of)) == 0)
    large = checkpointed(some.groupBy("key").agg((F.ceil(F.count("*") * sample_of / block)).cast("int").alias("blocks"), F.count("*").alias("c")).where(F.col("c") >= many).select("key", "blocks"))
    none = large.isEmpty()
    buckets = (bands if none else bands.join(_few(large), "key", "left_anti")).groupBy("key").agg(F.collect_list("rep").alias("m")).where(F.size("m") > 1)
    pairs = buckets.select("m", F.explode("m").alias("a")).select("a", F.explode(F.filter("m", lambda x: x > F.col("a"))).alias("b"))
    if none:
        return pairs.distinct()
    of = bands.join(_few(large), "key").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    of = of.join(reps.select("rep", "sketch", "n"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    of = of.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "sketch", "n")
    units = of.repartition(shuffle_partitions(reps), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return pairs.unionByName(units.mapInArrow(_blocks(least), "a long, b long")).distinct()


def classes(items: DataFrame, size: int = 5, min_words: int = 20, threshold: float = 0.8, sample_of: int = SAMPLE_OF, many: int = MANY, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """From items (gid, part, text), compared within a part: members (gid, rep, n: size of the class of copies) and links (a, b, similarity) between
    the representatives of classes, a < b. The defaults are five words and 0.8."""
    items = spread(items.select("gid", "text", F.col("part").cast("long").alias("part")).where("text IS NOT NULL AND gid IS NOT NULL AND part IS NOT NULL"))
    stored = saved(items.mapInArrow(_banding(size, min_words), "gid long, p1 long, p2 long, keys array<int>, sketch binary, n int"))
    least = threshold - 4 * (threshold * (1 - threshold) / ESTIMATE) ** 0.5
    reps = stored.groupBy("p1", "p2").agg(F.min("gid").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    pairs = _candidates(reps, least, sample_of, many, block)
    side = lambda s: stored.select(F.col("gid").alias(s), F.col("sketch").alias("r" + s), F.col("n").alias("n" + s))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_estimating(least), "a long, b long")
    near = checkpointed(near)
    sets = items.join(_few(near.select(F.explode(F.array("a", "b")).alias("gid")).distinct()), "gid", "left_semi").select("gid", "text").mapInArrow(_sets(size, min_words), "gid long, set binary")
    both = near.join(sets.select(F.col("gid").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("gid").alias("b"), F.col("set").alias("sb")), "b")
    links = checkpointed(both.select("a", "b", "sa", "sb").mapInArrow(_verifying(threshold), "a long, b long, similarity double").distinct())
    sizes = stored.groupBy("p1", "p2").agg(F.min("gid").alias("rep"), F.count("*").alias("n"))
    return stored.select("gid", "p1", "p2").join(sizes, ["p1", "p2"]).select("gid", "rep", "n"), links


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node, group_id (least node of the component) of all nodes of the links (a, b). In turn each node's greater neighbours, then all its neighbours not
    greater than itself, are linked to the least of them, until that changes nothing; the pairs left are a star around each least node."""
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        near = wide.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(near.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("group_id")).unionByName(edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("group_id")))


def near_pairs(items: DataFrame, size: int = 5, min_words: int = 20, threshold: float = 0.8, **how) -> DataFrame:
    """a, b (a < b) of all records at or above the threshold, copies included. Pairs of a class are written out by a task for each 2,000 members,
    those of two classes one side after the other, so the work is that of writing the pairs."""
    members, links = classes(items, size, min_words, threshold, **how)
    copies = checkpointed(members.where("n > 1"))
    parts = F.ceil(F.col("n") / 2000).cast("int")
    left = copies.select(F.col("gid").alias("a"), F.col("rep").alias("r"), F.pmod(F.xxhash64("gid"), parts).cast("int").alias("salt"))
    right = copies.select(F.col("gid").alias("b"), F.col("rep").alias("r"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    own = left.join(right, ["r", "salt"]).where("a < b").select("a", "b")
    # Most classes have one member: the left join leaves their links as they are.
    named = lambda m, r: copies.select(F.col("gid").alias(m), F.col("rep").alias(r))
    wide = links.select("a", "b").join(named("ma", "a"), "a", "left").join(named("mb", "b"), "b", "left")
    wide = wide.select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b"))
    return own.unionByName(wide).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def page_texts(distillations: DataFrame) -> DataFrame:
    """id, text: the page texts of pages_json in their order, joined by a blank line; null where the JSON is null or broken."""
    pages = F.from_json("pages_json", "array<struct<text:string>>")
    return distillations.select("id", F.when(F.col("pages_json").isNotNull(), F.array_join(F.transform(pages, lambda p: F.coalesce(p["text"], F.lit(""))), "\n\n")).alias("text"))
