"""Problem 8: mix sources to target weights along a curriculum.

Method: every source has a weight schedule over training time t in [0, 1], piecewise linear, whose integral is its share
of the whole. A source's tokens are used up along the integral of its schedule; inverting that integral at a document's
cumulative token offset gives the document its training position, and one range sort by position gives the order.

Defined results: a source's demand is target_share x total (``total_tokens``, else all tokens of the documents that take
part); it supplies at most max_repeats times its own tokens. A source without documents, or whose demand is beyond
that, is given in full and reported as short; its missing part is not shared out, so the others keep their proportions.
Documents without source, of a source without target, with null or empty text or of 0 tokens take no part; a null or
negative target_share counts as 0, a null max_repeats as 1; a source listed twice has its shares added and the smaller
max_repeats; a document id given twice counts as two documents. Whole passes come first; in the last pass documents are
taken in an order fixed by a hash of source and id while they begin before the demand is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ctxlake.llm.tokenizer import count_tokens
from ctxlake.runtime import checkpointed

#: Parts of the hash order of one source. Offsets are summed over parts first, so no task sees a whole source.
PARTS = 4096
#: Default curriculum: the weight at the start and at the end, as multiples of the share. Their mean is 1. The larger
#: half of the sources fades out, the smaller half (curated, repeated) fades in.
FADE = 0.4


def targets_of(targets: DataFrame) -> DataFrame:
    """source, share, repeats: one row a source."""
    share = F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0))
    rep = F.greatest(F.coalesce(F.col("max_repeats").cast("long"), F.lit(1)), F.lit(0))
    return targets.where("source IS NOT NULL").select("source", share.alias("s"), rep.alias("r")).groupBy("source").agg(F.sum("s").alias("share"), F.min("r").alias("repeats"))


def default_schedule(targets: DataFrame, fade: float = FADE) -> DataFrame:
    """source, knots: array of (t, w), w a multiple of the source's share."""
    t = targets_of(targets)
    mean = t.agg(F.avg("share").alias("m"))
    w = F.when(F.col("share") >= F.col("m"), F.lit(1 + fade)).otherwise(F.lit(1 - fade))
    return t.crossJoin(F.broadcast(mean)).select("source", F.array(F.struct(F.lit(0.0).alias("t"), w.alias("w")), F.struct(F.lit(1.0).alias("t"), (2 - w).alias("w"))).alias("knots"))


def integral(knots: Column) -> Column:
    """Segments (t0, t1, w0, w1, c0, c1) with the integral up to their ends."""
    seg = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.struct(F.element_at(knots, i).alias("a"), F.element_at(knots, i + 1).alias("b")))
    area = lambda s: (s["b"]["t"] - s["a"]["t"]) * (s["a"]["w"] + s["b"]["w"]) / 2
    out = lambda s, c: F.struct(s["a"]["t"].alias("t0"), s["b"]["t"].alias("t1"), s["a"]["w"].alias("w0"), s["b"]["w"].alias("w1"), c.alias("c0"), (c + area(s)).alias("c1"))
    start = F.array().cast("array<struct<t0:double,t1:double,w0:double,w1:double,c0:double,c1:double>>")
    return F.aggregate(seg, start, lambda acc, s: F.concat(acc, F.array(out(s, F.when(F.size(acc) == 0, F.lit(0.0)).otherwise(F.try_element_at(acc, F.lit(-1))["c1"])))))


def inverse(segments: Column, part: Column) -> Column:
    """The time at which the integral reaches ``part`` of its final value: a quadratic in the segment that holds it."""
    goal = part * F.element_at(segments, -1)["c1"]
    s = F.coalesce(F.try_element_at(F.filter(segments, lambda x: x["c1"] > goal), F.lit(1)), F.element_at(segments, -1))
    slope = (s["w1"] - s["w0"]) / (s["t1"] - s["t0"])
    rest = goal - s["c0"]
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * rest, F.lit(0.0)))
    return F.least(s["t0"] + 2 * rest / F.greatest(s["w0"] + root, F.lit(1e-300)), F.lit(1.0))


def sized(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, source, n_tokens of the documents that can take part, written once: they are needed in several places."""
    d = documents.where(F.col("source").isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    d = d.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string"), F.col(text_col).alias("text"))
    return checkpointed(count_tokens(d, "text", ("doc_id", "source"), path).where("n_tokens > 0"))


def plan(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """source, share, repeats, supply, demand, grant: a row for each target (a small table by nature)."""
    t = targets_of(targets)
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("supply"))
    t = t.join(have, "source", "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    total = F.broadcast(t.agg(F.sum("supply").alias("total"))) if total_tokens is None else F.broadcast(t.sparkSession.range(1).select(F.lit(total_tokens).cast("long").alias("total")))
    t = t.crossJoin(total).withColumn("demand", F.col("share") * F.col("total"))
    return t.withColumn("grant", F.least(F.col("demand"), (F.col("repeats") * F.col("supply")).cast("double")))


def offsets(docs: DataFrame) -> DataFrame:
    """Each document's token offset in its source's hash order, by sums over parts of the order and then within a part."""
    h = docs.withColumn("h", F.xxhash64("source", "doc_id")).withColumn("part", F.pmod(F.shiftright("h", 40), F.lit(PARTS)))
    sums = h.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    w = W.Window.partitionBy("source").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.select("source", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    v = W.Window.partitionBy("source", "part").orderBy("h", "doc_id", "n_tokens").rowsBetween(W.Window.unboundedPreceding, -1)
    inside = h.withColumn("inside", F.coalesce(F.sum("n_tokens").over(v), F.lit(0)))
    return inside.join(sums, ["source", "part"]).withColumn("at", F.col("before") + F.col("inside")).drop("h", "part", "before", "inside")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """doc_id, source, n_tokens, repeats (at least 1), at, supply, grant of the chosen documents. ``docs`` from sized()."""
    p = plan(docs, targets, total_tokens).where("grant > 0").select("source", "supply", "grant")
    d = offsets(docs).join(F.broadcast(p), "source")  # a row a source: as small as the list of targets
    passes = F.floor(F.col("grant") / F.col("supply"))
    rest = F.col("grant") - passes * F.col("supply")
    return d.withColumn("repeats", (passes + F.when(F.col("at") < F.bround(rest, 6), 1).otherwise(0)).cast("long")).where("repeats > 0")


def placed(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, schedule: DataFrame | None = None) -> DataFrame:
    """doc_id, source, n_tokens, repeats, positions: the chosen documents with the training position of each of their uses."""
    sched = (schedule if schedule is not None else default_schedule(targets)).select("source", integral(F.col("knots")).alias("seg"))
    m = mix(docs, targets, total_tokens).join(F.broadcast(sched), "source")  # a row a source
    through = lambda p: (F.col("at") + (p - 1) * F.col("supply") + F.col("n_tokens") / 2) / F.col("grant")
    at = F.transform(F.sequence(F.lit(1).cast("long"), F.col("repeats")), lambda p: F.round(inverse(F.col("seg"), F.least(through(p), F.lit(1.0))), 9))
    return m.select("doc_id", "source", "n_tokens", "repeats", at.alias("positions"))


def shares(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """A row for each target, from the placed uses: target_share, max_repeats, supply_tokens, used_tokens, used_docs, most_repeats, reached_share, short."""
    used = placed(docs, targets, total_tokens).groupBy("source").agg(F.sum(F.col("n_tokens") * F.size("positions")).alias("used"), F.count("*").alias("n"), F.max(F.size("positions")).cast("long").alias("m"))
    p = plan(docs, targets, total_tokens).join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    p = p.crossJoin(F.broadcast(p.agg(F.sum("used").alias("all"))))
    return p.select(
        "source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), F.col("supply").alias("supply_tokens"), F.col("used").alias("used_tokens"), F.coalesce("n", F.lit(0)).alias("used_docs"),
        F.coalesce("m", F.lit(0)).alias("most_repeats"), F.round(F.when(F.col("all") > 0, F.col("used") / F.col("all")).otherwise(0.0), 6).alias("reached_share"), (F.col("grant") < F.col("demand")).alias("short"),
    )


def curriculum(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, schedule: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """doc_id, source, n_tokens, pass_no, position: one row for each use of a document, in training order."""
    uses = placed(docs, targets, total_tokens, schedule).select("doc_id", "source", "n_tokens", F.posexplode("positions").alias("p", "position"))
    out = uses.select("doc_id", "source", "n_tokens", (F.col("p") + 1).cast("long").alias("pass_no"), "position")
    return out.orderBy("position", "source", "doc_id", "pass_no") if ordered else out
