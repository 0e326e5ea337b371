"""Problem 5: the k most similar vectors of every vector.

Method: vectors are brought to length 1, rotated by a fixed random orthogonal matrix, and put into lists around
centroids fitted on a bounded sample. Each vector probes its nearest lists. Within a list the columns come in blocks: after each
block, the partial squared distance over d of D rotated columns, scaled by D/d, is an estimate of the whole; a
candidate is abandoned once the estimate exceeds the bound by the margin (1 + eps / sqrt(d)) of a hypothesis test.
Survivors have their exact cosine.

Where a least cosine is given and no number of probes, nothing is lost: a query goes to every list that can hold such a
vector, by its distance from the plane between the list's centroid and its own nearest one and by the angles of the list's
members, and columns abandon a candidate only once its partial distance itself exceeds the bound.

The shared centroids are at most an eighth of the sample; where lists grow beyond that, each unit cuts its own into shorter ones (local centroids, the same bounds).

Hot groups: identical vectors are searched once, their copies are linked through a common class. A list of any length is
cut into blocks of at most ``block`` vectors, each its own task unit; queries go to every block of a list they probe.

Defined results: vectors that are null, empty, all zero, hold a null or non-finite number, or are not of their model's
usual length take no part; only vectors of one model are compared; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlake.runtime import checkpointed, sample_by_hash, shuffle_partitions


#: Vectors of a list, beyond twice which a unit cuts it up, and vectors on which that is fitted.
LOCAL_SIZE, LOCAL_SAMPLE = 2048, 4096
#: A vector without null or non-finite numbers and with one that is not 0.
USABLE = "forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('Infinity')) AND exists(vec, x -> x <> 0)"


def usual_length(df: DataFrame, model: str, vector: str) -> DataFrame:
    """model, usual: the length most of a model's vectors have (the smaller on a tie)."""
    n = df.where(F.size(vector) > 0).groupBy(F.col(model).alias("model"), F.size(vector).alias("d")).count()
    return n.groupBy("model").agg(F.max(F.struct("count", -F.col("d"))).alias("m")).select("model", (-F.col("m.col2")).alias("usual"))


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + d).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, 1) for i in range(0, len(x), 4096)])
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(n > 1e-9, s / np.maximum(n, 1e-9), x[rng.choice(len(x), len(c))])
    return c.astype(np.float32)


def clean(df: DataFrame, id_col: str, model: str, vector: str) -> DataFrame:
    """id, model, v: rotated unit vectors as bytes."""
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(model).cast("string").alias("model"), F.col(vector).cast("array<float>").alias("vec")).where("id IS NOT NULL AND model IS NOT NULL AND size(vec) > 0")
    d = d.join(F.broadcast(usual_length(d, "model", "vec")), "model").where(F.size("vec") == F.col("usual")).where(USABLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(2)
            flat, off = np.asarray(vec.values, np.float64), np.asarray(vec.offsets)
            out: list = [None] * b.num_rows
            for dim in set(np.diff(off).tolist()):
                rows = np.flatnonzero(np.diff(off) == dim)
                x = flat[off[rows][:, None] + np.arange(dim)]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                y = np.ascontiguousarray((x @ rotation(dim)).astype(np.float32))
                for r, v in zip(rows, y):
                    out[r] = v.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["id", "model", "v"])

    return d.select("id", "model", "vec").mapInArrow(run, "id long, model string, v binary")


def block_bounds(d: int, step: int) -> list[tuple[int, int]]:
    return [(i, min(i + step, d)) for i in range(0, d, step)]


def head_block(base: np.ndarray, step: int) -> np.ndarray:
    """The first column block with half of its squared norm, negative, beside it: one product with (q, 1) then gives q . b - |b|^2 / 2."""
    x = base[:, : min(step, base.shape[1])]
    return np.concatenate([x, (x**2).sum(1, keepdims=True) / -2], 1)


def scan(q: np.ndarray, base: np.ndarray, bound: np.ndarray, k: int, eps: float | None, step: int, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query, base, cosine) of up to k nearest of each query with squared distance of at most ``bound``.
    All queries of a probe pass over the first column block together, as one product of matrices and one comparison; then the test abandons pairs block by
    block. Without ``eps`` only what certainly lies beyond the bound is abandoned. ``head``: head_block(base, step), where it is at hand."""
    d = q.shape[1]
    blocks = block_bounds(d, step)

    def reach(hi: int) -> float:
        return d / hi if eps is None else (1 + eps / np.sqrt(hi)) ** 2

    hi = blocks[0][1]
    own = (q[:, :hi] ** 2).sum(1)
    s = np.concatenate([q[:, :hi], np.ones((len(q), 1), q.dtype)], 1) @ (head_block(base, step) if head is None else head).T
    at = np.flatnonzero(s >= ((own - (bound * (reach(hi) if hi < d else 1.0) + 1e-5) * (hi / d)) / 2)[:, None])
    qi, bi = np.divmod(at, len(base))
    if len(at) * 4 > s.size:  # few were abandoned: the dense product is cheaper than gathering
        at = np.flatnonzero(2 - 2 * (q @ base.T) <= bound[:, None] + 1e-5)
        qi, bi = np.divmod(at, len(base))
        blocks = blocks[:1]
    dist = own[qi] - 2 * s.ravel()[at]
    for lo, hi in blocks[1:]:
        if not len(qi):
            break
        dist = dist + ((q[qi, lo:hi] - base[bi, lo:hi]) ** 2).sum(1)
        keep = dist * (d / hi) <= bound[qi] * (reach(hi) if hi < d else 1.0) + 1e-5
        qi, bi, dist = qi[keep], bi[keep], dist[keep]
    return qi, bi, 1 - np.einsum("ij,ij->i", q[qi] - base[bi], q[qi] - base[bi]) / 2 if len(qi) else np.zeros(0, np.float32)


def _probe(centroids: dict[str, np.ndarray], probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model, raw = np.asarray(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            near: list = [None] * b.num_rows
            for m in set(model):
                rows, c = np.flatnonzero(model == m), centroids[m]
                x = np.frombuffer(b"".join(raw[r] for r in rows), np.float32).reshape(len(rows), -1)
                sim, n = x @ c.T, min(probes, len(c))
                top = np.argpartition(-sim, n - 1, 1)[:, :n]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), 1), 1)
                for r, t in zip(rows, top.tolist()):
                    near[r] = t
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.list_(pa.int32()))], names=[*b.schema.names, "near"])

    return run


def _nearest(k: int, min_cosine: float, eps: float, step: int):
    most = np.float32(2 - 2 * min_cosine)

    def answer(ids, q, base_ids, base):
        """Up to k of this block for each query. The bound of a query is its k-th distance within the block's first rows."""
        bound = np.full(len(q), most, np.float32)
        head = min(len(base), max(4 * k, 64))
        if len(base) > head:
            d = 2 - 2 * (q @ base[:head].T)
            bound = np.minimum(bound, np.partition(d, min(k, head - 1), 1)[:, min(k, head - 1)])
        qi, bi, cos = scan(q, base, bound, k, eps, step)
        keep = (ids[qi] != base_ids[bi]) & (cos >= min_cosine)
        qi, bi, cos = qi[keep], bi[keep], cos[keep]
        order = np.lexsort((base_ids[bi], -cos, qi))
        qi, bi, cos = qi[order], bi[order], cos[order]
        first = np.searchsorted(qi, qi)
        top = np.arange(len(qi)) - first < k
        return ids[qi[top]], base_ids[bi[top]], cos[top].astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base_ids, base = None, [], []
        for b in batches:
            unit = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()))
            ids, raw = np.asarray(b.column(4)), b.column(5).to_pylist()
            cuts = [0, *(i for i in range(1, len(unit)) if unit[i] != unit[i - 1]), len(unit)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if unit[lo][:3] != key:
                    key, base_ids, base = unit[lo][:3], [], []
                x = np.frombuffer(b"".join(raw[lo:hi]), np.float32).reshape(hi - lo, -1)
                if unit[lo][3] == 0:
                    base_ids.append(ids[lo:hi])
                    base.append(x)
                elif base:
                    if len(base) > 1:
                        base_ids, base = [np.concatenate(base_ids)], [np.concatenate(base)]
                    for i in range(0, hi - lo, 512):
                        got = answer(ids[lo + i : min(hi, lo + i + 512)], x[i : i + 512], base_ids[0], base[0])
                        if len(got[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["q", "o", "cosine"])

    return run


def _may_hold(sim: np.ndarray, c: np.ndarray, lists: np.ndarray, min_cosine: float) -> np.ndarray:
    """Which of ``lists`` can hold a vector with ``min_cosine`` to a query. Members of a list lie on its centroid's side of the
    plane between that and any other centroid; from a query at distance t beyond that plane none has a cosine above sqrt(1 - t^2)."""
    if min_cosine <= 0:
        return np.ones((len(sim), len(lists)), bool)
    own = sim.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (c @ c[lists].T), 0))[own]
    return sim[np.arange(len(sim)), own][:, None] - sim[:, lists] <= np.sqrt(1 - min_cosine**2) * apart + 1e-5


def _route(centroids: dict[str, np.ndarray], groups: dict[str, list[np.ndarray]], min_cosine: float, half: bool):
    """Adds groups: those a query goes to; with ``half`` none before its own, as the rest meet it as queries of theirs. The last column is the list of the
    query itself, which its own group takes the place of."""
    of_list = {m: np.zeros(len(c), np.int32) for m, c in centroids.items()}
    for m, gs in groups.items():
        for g, lists in enumerate(gs):
            of_list[m][lists] = g

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model, raw = np.asarray(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            to: list = [None] * b.num_rows
            own = np.asarray(b.column(3)).copy()
            for m in set(model):
                rows, c = np.flatnonzero(model == m), centroids[m]
                own[rows] = of_list[m][own[rows]]
                for i in range(0, len(rows), 1024):
                    part = rows[i : i + 1024]
                    x = np.frombuffer(b"".join(raw[r] for r in part), np.float32).reshape(len(part), -1)
                    sim = x @ c.T
                    asked = np.stack([_may_hold(sim, c, lists, min_cosine).any(1) for lists in groups[m]], 1)
                    if half:
                        asked &= np.arange(len(groups[m])) >= own[part][:, None]
                    for r, a in zip(part, asked):
                        to[r] = np.flatnonzero(a).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(own, pa.int32()), pa.array(to, pa.list_(pa.int32()))], names=[*b.schema.names[:3], "own", "groups"])

    return run


def _every(k: int, min_cosine: float, centroids: dict[str, np.ndarray], step: int):
    """Like _nearest, for units of several lists, each compared with all queries whose neighbours it can hold (role 1). What queries of other groups (role 2)
    find counts for both sides, as the vectors of a unit are no queries of their groups then."""
    most, alpha = np.float32(2 - 2 * min_cosine), np.arccos(max(-1.0, min_cosine))

    def best(q, o, cos):
        order = np.lexsort((o, -cos, q))
        q, o, cos = q[order], o[order], cos[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[top], o[top], cos[top].astype(np.float64)

    def answer(ids, q, both, c, lists, members, heads):
        may, angle, found = _may_hold(q @ c.T, c, lists, min_cosine), np.arccos(np.clip(q @ heads.T, -1, 1)), []
        for m, (j, base_ids, base, block, lo, hi) in enumerate(members):
            rows = np.flatnonzero(may[:, j] & (angle[:, m] <= hi + alpha + 1e-3) & (angle[:, m] >= lo - alpha - 1e-3))
            x = q if len(rows) == len(q) else q[rows]
            for i in range(0, len(base) if len(rows) else 0, 4096):
                qi, bi, cos = scan(x, base[i : i + 4096], np.full(len(rows), most, np.float32), k, None, step, block[i : i + 4096])
                keep = (ids[rows[qi]] != base_ids[i + bi]) & (cos >= min_cosine)
                found.append((rows[qi[keep]], base_ids[i + bi[keep]], cos[keep]))
        qi, o, cos = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        out = best(ids[qi], o, cos)
        return [np.concatenate(x) for x in zip(out, best(o, ids[qi], cos))] if both else out

    def by_list(c, base):
        """The lists of a unit, a long one cut into lists of its own around centroids fitted here on at most LOCAL_SAMPLE of its vectors, each with the angles of
        its members, so the number of lists grows with the vectors though that of the shared centroids does not."""
        ids, own, x = (np.concatenate(a) for a in zip(*base))
        lists, members, heads = np.unique(own), [], []
        for at, j in enumerate(lists):
            r = np.flatnonzero(own == j)
            parts = len(r) // LOCAL_SIZE
            local = c[j : j + 1] if parts < 2 else fit_centroids(x[r[:: max(1, len(r) // LOCAL_SAMPLE)]], parts, rounds=3)
            side = np.zeros(len(r), int) if parts < 2 else np.concatenate([np.argmax(x[r[i : i + 4096]] @ local.T, 1) for i in range(0, len(r), 4096)])
            for g in np.unique(side):
                rows = r[side == g]
                angle = np.arccos(np.clip(x[rows] @ local[g], -1, 1))
                members.append((at, ids[rows], x[rows], head_block(x[rows], step), angle.min(), angle.max()))
                heads.append(local[g])
        return lists, members, np.array(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, held = None, [], None
        for b in batches:
            unit = list(zip(*(b.column(i).to_pylist() for i in range(5))))
            own, ids, raw = np.asarray(b.column(5)), np.asarray(b.column(6)), b.column(7).to_pylist()
            cuts = [0, *(i for i in range(1, len(unit)) if unit[i] != unit[i - 1]), len(unit)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if unit[lo][:4] != key:
                    key, base, held = unit[lo][:4], [], None
                x = np.frombuffer(b"".join(raw[lo:hi]), np.float32).reshape(hi - lo, -1)
                if unit[lo][4] == 0:
                    base.append((ids[lo:hi], own[lo:hi], x))
                elif base or held:
                    if held is None:
                        held, base = by_list(centroids[key[0]], base), []
                    for i in range(0, hi - lo, 2048):
                        got = answer(ids[lo + i : min(hi, lo + i + 2048)], x[i : i + 2048], unit[lo][4] == 2, centroids[key[0]], *held)
                        if len(got[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(a) for a in got], names=["q", "o", "cosine"])

    return run


def _all_near(placed: DataFrame, centroids: dict[str, np.ndarray], k: int, min_cosine: float, block: int, step: int, half: bool) -> DataFrame:
    """q, o, cosine: nothing left out. With ``half`` (every vector asks) two groups meet once, not twice. Neighbouring lists form groups, about six a model, of ``block`` to 64 times as many
    vectors; a unit is a group (a block of it, where one list exceeds that) and a slice of the queries, so vectors move seldom."""
    counts: dict[str, np.ndarray] = {m: np.zeros(len(c), np.int64) for m, c in centroids.items()}
    for r in placed.groupBy("model", F.col("near")[0].alias("list")).count().collect():
        counts[r.model][r.list] = r["count"]
    groups, of_list, of_group = {}, [], []
    for m, c in centroids.items():
        most = min(64 * block, max(block, -(-int(counts[m].sum()) // 6)))
        side = np.argmax(c @ fit_centroids(c, max(1, int(counts[m].sum()) // most)).T, 1)
        filled, of = most, []
        for j in np.argsort(side, kind="stable").tolist():
            if filled + counts[m][j] > most:
                of.append([])
                filled = 0
            of[-1].append(j)
            filled += int(counts[m][j])
        groups[m] = [np.asarray(js) for js in of]
        for g, js in enumerate(of):
            blocks = max(1, -(-int(counts[m][js].sum()) // most))
            of_list += [(m, j, g, blocks) for j in js]
            of_group.append((m, g, blocks))
    spark, parts = placed.sparkSession, shuffle_partitions(placed)
    slices = max(1, -(-3 * parts // max(1, len(of_group))))
    slice_of = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(slices)).cast("int")
    lists = F.broadcast(spark.createDataFrame(of_list, "model string, list int, group int, blocks int"))
    base = placed.select("model", F.col("near")[0].alias("list"), "id", "v").join(lists, ["model", "list"])
    base = base.select("model", "group", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("role"), "list", "id", "v")
    asked = placed.where("asks = 1").select("model", "v", "id", F.col("near")[0].alias("own")).mapInArrow(_route(centroids, groups, min_cosine, half), "model string, v binary, id long, own int, groups array<int>")
    asked = asked.select("model", F.explode("groups").alias("group"), "id", "v", "own").join(F.broadcast(spark.createDataFrame(of_group, "model string, group int, blocks int")), ["model", "group"])
    asked = asked.select("model", "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), slice_of.alias("slice"), F.when(F.lit(half) & (F.col("own") != F.col("group")), 2).otherwise(1).alias("role"), F.lit(0).alias("list"), "id", "v")
    work = base.unionByName(asked).repartition(parts, "model", "group", "block", "slice").sortWithinPartitions("model", "group", "block", "slice", "role")
    return work.mapInArrow(_every(k, min_cosine, centroids, step), "q long, o long, cosine double")


def _probed(placed: DataFrame, centroids: dict[str, np.ndarray], k: int, min_cosine: float, block: int, eps: float, step: int) -> DataFrame:
    """q, o, cosine, of the lists each query looks into."""
    spark = placed.sparkSession
    sizes = placed.groupBy("model", F.col("near")[0].alias("list")).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).collect()
    many = {(r.model, r.list): r.blocks for r in sizes}
    units = spark.createDataFrame([(m, i, many.get((m, i), 0)) for m, c in centroids.items() for i in range(len(c))], "model string, list int, blocks int")
    base = placed.select("model", F.col("near")[0].alias("list"), "id", "v").join(F.broadcast(units), ["model", "list"])
    base = base.select("model", "list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "id", "v")
    ask = placed.where("asks = 1").select("model", F.explode("near").alias("list"), "id", "v").join(F.broadcast(units.where("blocks > 0")), ["model", "list"])
    ask = ask.select("model", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "id", "v")
    work = base.unionByName(ask).repartition(shuffle_partitions(placed), "model", "list", "block").sortWithinPartitions("model", "list", "block", "role")
    return work.mapInArrow(_nearest(k, min_cosine, eps, step), "q long, o long, cosine double")


def neighbours(
    df: DataFrame, id_col: str = "chunk_id", model: str = "model", vector: str = "vector", k: int = 5, min_cosine: float = -1.0, query_every: int = 1, list_size: int = 256, probes: int | float | None = 8, sample: int = 20_000, block: int = 2048, eps: float = 2.1, step: int = 16
) -> DataFrame:
    """id, other, cosine, rank: up to k nearest others of each vector (of those whose id is divisible by ``query_every``)
    with a cosine of at least ``min_cosine``. Centroids are fitted on at most ``sample`` vectors of a model (by a hash of
    the id); there are about n / list_size of them, sample / 8 at most. ``probes``: lists a query looks into, as a number or, under 1,
    as a part of all lists; None for every list that can hold a vector of ``min_cosine``. The driver gets the models, that sample, and a count for each list."""
    vecs = checkpointed(clean(df, id_col, model, vector))
    reps = vecs.groupBy("model", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.max(F.when(F.col("id") % query_every == 0, 1).otherwise(0)).alias("asks"))
    centroids: dict[str, np.ndarray] = {}
    for m, n in sorted(vecs.groupBy("model").agg(F.count("*").alias("n")).collect()):
        rows = sample_by_hash(vecs.where(F.col("model") == m), n, sample, "id").select("v").collect()
        x = np.frombuffer(b"".join(bytes(r.v) for r in rows), np.float32).reshape(len(rows), -1)
        centroids[m] = fit_centroids(x, max(1, min(round(n / list_size), sample // 8)))
    lists = max(map(len, centroids.values()), default=1)
    looks = 1 if probes is None else max(1, round(probes * lists)) if probes < 1 else int(probes)
    placed = checkpointed(reps.select("model", "v", "id", "n", "asks").mapInArrow(_probe(centroids, looks), "model string, v binary, id long, n long, asks int, near array<int>"))
    near = _all_near(placed, centroids, k, min_cosine, block, step, query_every == 1) if probes is None else _probed(placed, centroids, k, min_cosine, block, eps, step)
    near = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "o"))), 1, k).alias("c")).select("q", F.explode("c").alias("c")).select("q", "c.o", (-F.col("c.d")).alias("cosine"))
    return _with_copies(vecs, placed.select("model", "v", F.col("id").alias("rep"), "n"), near, k, query_every)


def _with_copies(vecs: DataFrame, reps: DataFrame, near: DataFrame, k: int, query_every: int) -> DataFrame:
    """Classes of identical vectors back to ids. Of a class only its k + 1 smallest ids can be anyone's neighbours."""
    copies = vecs.join(reps.where("n > 1").select("model", "v", "rep"), ["model", "v"]).select("id", "rep")
    salted = copies.groupBy("rep", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("s")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    first = salted.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    members = copies.unionByName(reps.where("n = 1").select(F.col("rep").alias("id"), "rep")).where(F.col("id") % query_every == 0)
    of_class = near.join(first, near.o == first.rep, "left").select("q", F.explode(F.coalesce("ids", F.array("o"))).alias("other"), "cosine")
    own = members.join(first, "rep").select("id", F.explode("ids").alias("other"), F.lit(1.0).alias("cosine")).where("id <> other")
    all_ = members.join(of_class, F.col("rep") == F.col("q")).select("id", "other", "cosine").unionByName(own)
    best = all_.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "other"))), 1, k).alias("c"))
    return best.select("id", F.posexplode("c").alias("p", "c")).select("id", "c.other", (-F.col("c.d")).alias("cosine"), (F.col("p") + 1).alias("rank"))


def near_pairs(df: DataFrame, k: int = 5, min_cosine: float = 0.9, probes: int | float | None = None, **how) -> DataFrame:
    """a, b (a < b), where one is among the k nearest of the other and their cosine is at least ``min_cosine``."""
    n = neighbours(df, k=k, min_cosine=min_cosine - 1e-6, probes=probes, **how).where(F.col("cosine") >= min_cosine - 1e-7)
    return n.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
