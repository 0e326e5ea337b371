"""Keyword index and ranked retrieval. The index is four stored tables: postings (term, doc, dl, f), in the order of terms; lengths (doc, dl); terms (term, df, idf); totals (n,
avgdl). A query reads only the postings of its own terms, which the files' statistics find, and shuffles nothing before its final sum; scores of all other
documents are zero and fill up the result only where too few match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ctxlake.functions.text import index_terms, let, strip
from ctxlake.functions.tokens import cosine, norm
from ctxlake.runtime import shuffle_partitions, spread

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of a question table that are broadcast, and terms that go into the filter of the scan; beyond, a shuffle joins them.
BROADCAST_ROWS, FILTER_TERMS = 200_000, 1000


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    totals: DataFrame


def counted(terms: Column) -> Column:
    """array<struct<term, f>> of an array of terms: sorted, then each run's length, all within the row."""
    n = F.size(terms)

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda x, k: F.struct(F.get(s, x).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - x).cast("long").alias("f"))))

    return F.when(n > 0, let(F.sort_array(terms), runs)).otherwise(F.array().cast("array<struct<term:string,f:bigint>>"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t")))


def by_document(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """doc, dl, terms: one pass over the texts, no shuffle."""
    return _texts(docs, id_col, text_col).select("doc", index_terms("t").alias("t")).select("doc", F.size("t").alias("dl"), counted(F.col("t")).alias("terms"))


def postings(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """doc, dl, term, f. All of a document's come out of one expression, and an outer explosion infers no filter, either of which would compute its terms again."""
    of = let(index_terms("t"), lambda t: F.transform(counted(t), lambda x: F.struct(F.size(t).alias("dl"), x["term"].alias("term"), x["f"].alias("f"))))
    p = _texts(docs, id_col, text_col).select("doc", F.explode_outer(of).alias("p"))
    return p.select("doc", "p.dl", "p.term", "p.f").where("term IS NOT NULL")


def term_stats(posts: DataFrame, totals: DataFrame) -> DataFrame:
    """term, df, idf; a negative idf becomes a part of the mean idf over the vocabulary."""
    df = posts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals.select("n")))  # one row
    raw = df.withColumn("idf0", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf0").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("idf0") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("idf0")).alias("idf"))  # one row


def build(docs: DataFrame, id_col: str, path: str, text_col: str = "text") -> Index:
    """Write the index under ``path``. The texts are read once; postings are then ranged by term and document, so a common term spreads over several files."""
    spark = docs.sparkSession
    by_document(docs, id_col, text_col).write.mode("overwrite").parquet(f"{path}/documents")
    d = spark.read.parquet(f"{path}/documents")
    d.select("doc", "dl").write.mode("overwrite").parquet(f"{path}/lengths")
    p = d.select("doc", "dl", F.explode_outer("terms").alias("t")).select("t.term", "doc", "dl", "t.f").where("term IS NOT NULL")
    p.repartitionByRange(shuffle_partitions(d), "term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
    d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/totals")
    term_stats(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals")).write.mode("overwrite").parquet(f"{path}/terms")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "terms", "totals")))


def query_terms(questions: DataFrame, id_col: str = "q", text_col: str = "question") -> DataFrame:
    return questions.select(F.col(id_col).alias("q"), F.explode(index_terms(text_col)).alias("term")).groupBy("q", "term").agg(F.count("*").alias("m"))


def scores(index: Index, questions: DataFrame) -> DataFrame:
    """q, doc, bm25 of the documents that hold a term of the question. The terms of the questions with their weights are a small table, which is counted; it is
    broadcast, and few terms become a filter of the scan."""
    asked = query_terms(questions)
    rows = asked.limit(BROADCAST_ROWS + 1).collect()
    posts, terms = index.postings, index.terms
    if len(rows) <= BROADCAST_ROWS:
        asked = F.broadcast(posts.sparkSession.createDataFrame(rows, asked.schema))
        few = sorted({r.term for r in rows})
        if len(few) <= FILTER_TERMS:
            posts, terms = posts.where(F.col("term").isin(few)), terms.where(F.col("term").isin(few))
        weights = F.broadcast(terms.join(asked, "term").select("term", "q", (F.col("m") * F.col("idf")).alias("w")))
    else:
        weights = terms.join(asked, "term").select("term", "q", (F.col("m") * F.col("idf")).alias("w"))
    hit = posts.join(weights, "term").crossJoin(F.broadcast(index.totals.select("avgdl")))  # one row
    part = F.col("w") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("q", "doc").agg(F.sum(part).alias("bm25"))


def normalised(scored: DataFrame, questions: DataFrame) -> DataFrame:
    """q, doc, score: by the question's greatest score; 0 where none is above 0. The greatest scores are a row a question: counted, and broadcast, so the documents of
    a question never meet in one task."""
    top = scored.groupBy("q").agg(F.max("bm25").alias("top"))
    top = F.broadcast(top) if questions.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else top
    return scored.join(top, "q").select("q", "doc", F.when(F.col("top") > 0, F.col("bm25") / F.col("top")).otherwise(F.lit(0.0)).alias("score"))


def top_k(scored: DataFrame, lens: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """q, doc, score, rank: always min(k, N) rows a question; ties by document. Only the k first documents can fill up with zeros, besides those
    scored, so no question meets all documents."""
    fill = lens.orderBy("doc").limit(k).select("doc")
    zero = questions.select("q").crossJoin(F.broadcast(fill)).join(scored.select("q", "doc"), ["q", "doc"], "left_anti").withColumn("score", F.lit(0.0))  # k rows
    # A negative score still ranks below the zeros.
    # A rank with a limit is cut down in every task before the shuffle, so a common term's documents never meet in one task.
    w = W.Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    best = scored.select("q", "doc", "score").unionByName(zero).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("q", "doc", F.round("score", 4).alias("score"), "rank")


def _compared(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """q, model, doc, cos. Each vector's norm is computed once, whatever the number of questions."""
    v = vectors.select("doc", "model", "vector", norm(F.col("vector")).alias("nv"))
    a = asked.select("q", "model", "qv", norm(F.col("qv")).alias("nq"))
    return v.join(F.broadcast(a), "model").select("q", "model", "doc", cosine(F.col("vector"), F.col("qv"), F.col("nv"), F.col("nq")).alias("cos"))


def cosines(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """q, doc, cos of every vector (doc, model, vector) with the questions' vectors (q, model, qv) of its model: a stated query set, a row a question and
    model, against all rows. Vectors stay where they are; only the cosines go on."""
    return _compared(vectors, asked).select("q", "doc", "cos")


def cosine_top(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """q, model, doc, score, rank: the k documents of each model nearest to each question's vector."""
    c = _compared(vectors, asked).select("q", "model", "doc", F.round("cos", 4).alias("score"))
    w = W.Window.partitionBy("q", "model").orderBy(F.desc("score"), "doc")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def blend(scored: DataFrame, cos: DataFrame, weight: float = 0.5) -> DataFrame:
    """q, doc, score: keyword score and cosine by weight for documents with a vector; the others keep their keyword score."""
    both = scored.select("q", "doc", "score").join(cos, ["q", "doc"], "full")
    kw = F.coalesce("score", F.lit(0.0))
    return both.select("q", "doc", F.when(F.col("cos").isNull(), kw).otherwise((1 - weight) * kw + weight * F.col("cos")).alias("score"))


def answers(best: DataFrame, docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", shown: int = 300) -> DataFrame:
    """The ranked documents with their source and the beginning of their text: the few ranked rows are broadcast, so the texts stay where they are."""
    d = docs.select(F.col(id_col).alias("doc"), "source_path", "chunk_index", F.col(text_col).alias("_t"))
    cut = F.concat(strip(F.substring("_t", 1, shown)), F.when(F.length("_t") > shown, F.lit("...")).otherwise(F.lit("")))
    return d.join(F.broadcast(best), "doc").select("q", "rank", "doc", "score", "source_path", "chunk_index", cut.alias("preview"))
