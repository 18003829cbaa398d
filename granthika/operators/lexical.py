"""Lexical retrieval (BM25) and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granthika.functions.text import tokens
from granthika.operators.skew import skew_join
from granthika.session import cut

K1, B, RRF_K = 1.5, 0.75, 60
#: query terms (a query and a term each) up to which they are broadcast, some 40 bytes each
WEIGHTS = 200_000


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, dl, terms``: of each document its tokens counted where they lie, as an array of ``term, tf``."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.element_at(t, i) != F.element_at(t, F.greatest(i - 1, F.lit(1)))))
        one = lambda s: F.transform(s, lambda x, k: F.struct(F.element_at(t, x).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t) + 1) - x).cast("bigint").alias("tf")))
        return F.transform(F.array(starts), one)[0]

    sorted_ = F.sort_array(tokens(F.col("text")))
    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    terms = F.transform(F.array(sorted_), lambda t: F.struct(F.size(t).alias("dl"), F.when(F.size(t) > 0, runs(t)).otherwise(none).alias("terms")))[0]
    return docs.select("doc_id", terms.alias("_d")).select("doc_id", "_d.dl", "_d.terms")


def postings(docs: DataFrame) -> DataFrame:
    """``term, doc_id, tf, dl`` of ``docs`` (``doc_id, text``; one row a document); no stop words, no stemming, no shuffle."""
    return counted(docs).select("doc_id", "dl", F.explode("terms").alias("_p")).select("_p.term", "doc_id", "_p.tf", "dl")


def term_stats(post: DataFrame) -> DataFrame:
    """``term, df``."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = K1, b: float = B, most_weights: int = WEIGHTS) -> DataFrame:
    """``query_id, doc_id, score, rank``: BM25 (Lucene's form), the ``k`` best per query.

    ``queries`` has ``query_id, text``, ``docs`` ``doc_id, text`` with one row a document. A query term counts once per
    occurrence; a query without tokens has no hit, nor has a document without a common term. Scores are
    compared to nine decimals, ties by id.

    The texts are read once: postings of terms that no query has are dropped at once, and an empty term
    counts the documents and their lengths. Up to ``most_weights`` query terms are broadcast, so that a
    document is scored where its postings lie and each task passes on its ``k`` best; beyond that the postings
    meet the terms in a shuffle, frequent terms over salts.
    """
    q = cut(queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf")))
    few = q.limit(most_weights + 1).count() <= most_weights
    wanted = q.select("term").distinct().unionByName(q.sparkSession.createDataFrame([("",)], "term string"))
    whole = F.array(F.struct(F.lit("").alias("term"), F.col("dl").cast("bigint").alias("tf")))
    each = counted(docs).select("doc_id", "dl", F.explode(F.concat("terms", whole)).alias("_p")).select("_p.term", "doc_id", "_p.tf", "dl")
    used = cut(each.join(F.broadcast(wanted) if few else wanted, "term", "left_semi"))
    stats = used.where("term = ''").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("tf").alias("avgdl")).select(F.struct("n_docs", "avgdl").alias("whole")).scalar()
    # a document's postings come together, so that neither its scores nor their sums need another shuffle
    post = used.where("term <> ''").repartition("doc_id")
    idf = F.log(1 + (stats["n_docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = q.join(term_stats(used.where("term <> ''")), "term").select("query_id", "term", (F.col("qf") * idf).alias("w"))
    met = post.join(F.broadcast(weights), "term") if few else skew_join(post, weights, ["term"], F.col("doc_id"))
    part = F.col("w") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / stats["avgdl"]))
    scored = met.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    best = scored.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= k)
    return best.select("query_id", "doc_id", "score", (F.col("_no") - 1).alias("rank"))


def fuse(lists: list[DataFrame], k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """``query_id, doc_id, score, rank``: reciprocal rank fusion of ranked lists (``query_id, doc_id, rank``).

    Ranks begin at 0; a document listed twice in one list counts twice; ties go to the earlier list,
    the better rank, then the smaller id. No list gives an error.
    """
    if not lists:
        raise ValueError("no ranked list")
    every = None
    for no, ranked in enumerate(lists):
        one = ranked.select("query_id", "doc_id", "rank", F.lit(no).alias("list_no"))
        every = one if every is None else every.unionByName(one)
    s = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank") + 1)), 12).alias("score"), F.min(F.struct("list_no", "rank")).alias("_first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "_first.list_no", "_first.rank", "doc_id")
    return s.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("query_id", "doc_id", "score", "rank")
