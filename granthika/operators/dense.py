"""Dense retrieval: exact, by sign bits, by int8, and in two tiers.

Where there are few queries, at most one block of them, each task holds them and passes over its part of the
corpus in place. Beyond that queries and corpus are dealt into blocks of bounded size, each pair of blocks is
one task's matrix product, and both sides may grow. Either way a task keeps its best few rows per query, and those
meet in a top-k per query; the work is queries times corpus, which is what exact search costs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granthika.functions.vectors import int8

QUERY_BLOCK, CORPUS_BLOCK = 4096, 50_000
HITS = "query_id bigint, hit_id bigint, score double"
#: scores are compared to nine decimals, so that equal vectors tie on every machine
DIGITS = 9


def _blocks(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


def _unit(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64)


def _int8(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x.astype(np.float32) * np.float32(127)), -127, 127).astype(np.float64)


def _signs(x: np.ndarray) -> np.ndarray:
    """Signs as -1 and 1, so that the product counts agreeing minus differing bits."""
    return np.where(x > 0, 1.0, -1.0)


FORMS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"float": _unit, "int8": _int8, "bits": _signs}


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best rows of each query, ties by the smaller id: never more than ``k`` a query."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
    return order[rank < k]


def _scored(a: np.ndarray, own: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, form: str, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, places of rows, and scores of what may be among the ``k`` best of these rows."""
    outs = []
    for at in range(0, len(own), 256):
        s = np.round(a[at : at + 256] @ b.T, DIGITS)
        if form == "bits":
            s = (s - a.shape[1]) / 2
        if exclude_self:
            s = np.where(own[at : at + 256, None] == ids[None, :], -np.inf, s)
        m = min(k, s.shape[1])
        edge = -np.partition(-s, m - 1, axis=1)[:, m - 1]
        i, j = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
        kept = _best(i, ids[j], s[i, j], k)
        outs.append((at + i[kept], j[kept], s[i, j][kept] + 0.0))
    return tuple(np.concatenate(x) for x in zip(*outs))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _in_place(block: pa.Table, corpus: DataFrame, k: int, form: str, exclude_self: bool) -> DataFrame:
    """``candidates`` of a bounded block of queries, which every task gets; the corpus stays where it is."""
    own = block.column("vec_id").to_numpy()
    held = corpus.sparkSession.sparkContext.broadcast((own, FORMS[form](_matrix(block.column("embedding").combine_chunks()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, a = held.value
        q, hit, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            if not batch.num_rows or not len(own):
                continue
            ids = batch.column("vec_id").to_numpy()
            i, j, s = _scored(a, own, FORMS[form](_matrix(batch.column("embedding"))), ids, k, form, exclude_self)
            q, hit, score = np.concatenate([q, own[i]]), np.concatenate([hit, ids[j]]), np.concatenate([score, s])
            kept = _best(q, hit, score, k)
            q, hit, score = q[kept], hit[kept], score[kept]
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(hit), pa.array(score)], names=["query_id", "hit_id", "score"])

    return corpus.mapInArrow(run, HITS)


def candidates(queries: DataFrame, corpus: DataFrame, k: int, form: str = "float", exclude_self: bool = True, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """Per query and part of the corpus the ``k`` best: ``query_id, hit_id, score``.

    Both sides have ``vec_id, embedding``, all vectors of one length. Rows with a null vector are left out. For ``bits``
    the score is minus the number of differing bits.
    """
    shape = FORMS[form]
    pick = lambda df: df.where("embedding is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    block = pick(queries).limit(query_block + 1).toArrow()  # no more than a block is ever asked for
    if block.num_rows <= query_block:
        return _in_place(block, pick(corpus), k, form, exclude_self)
    nq, nc = _blocks(queries, query_block), _blocks(corpus, corpus_block)
    deal = lambda df, n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    q = pick(queries).withColumn("qb", deal(queries, nq)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    c = pick(corpus).withColumn("cb", deal(corpus, nc)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def best(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "hit_id": [], "score": []}).astype({"query_id": "int64", "hit_id": "int64", "score": "float64"})
        own, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        i, j, s = _scored(shape(np.stack(left["embedding"])), own, shape(np.stack(right["embedding"])), ids, k, form, exclude_self)
        return pd.DataFrame({"query_id": own[i], "hit_id": ids[j], "score": s})

    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(best, HITS)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """``query_id, hit_id, score, rank``: the ``k`` best per query, rank from 0, ties by id; each task passes on no
    more than ``k`` rows a query (Spark's limit of window groups)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "hit_id")
    best = hits.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= k)
    return best.select("query_id", "hit_id", "score", (F.col("_no") - 1).alias("rank"))


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, form: str = "float", exclude_self: bool = True) -> DataFrame:
    """``query_id, hit_id, score, rank`` of the ``k`` nearest rows of ``corpus`` for each query.

    An empty side gives no row; a corpus of fewer rows gives all of them.
    """
    return ranked(candidates(queries, corpus, k, form, exclude_self), k)


def two_tier(queries: DataFrame, corpus: DataFrame, k: int = 10, depth: int = 200) -> DataFrame:
    """The ``depth`` nearest by sign bits, scored again by int8 inner product, the ``k`` best of them."""
    first = top_k(queries, corpus, depth, "bits").select("query_id", "hit_id")
    a = queries.select(F.col("vec_id").alias("query_id"), int8(F.col("embedding")).alias("_q"))
    b = corpus.select(F.col("vec_id").alias("hit_id"), int8(F.col("embedding")).alias("_c"))
    score = F.aggregate(F.zip_with("_q", "_c", lambda x, y: x.cast("bigint") * y.cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + v).cast("double")
    return ranked(first.join(a, "query_id").join(b, "hit_id").select("query_id", "hit_id", score.alias("score")), k)


def two_tier_exact(queries: DataFrame, corpus: DataFrame, k: int = 10, depth: int = 200, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """The ``k`` best by int8 inner product, all of them: of each block pair the ``depth`` nearest by sign bits
    set a score to reach, and every other row is scored too unless its signs prove that it stays below.

    Where signs differ a product is not positive, so the score is at most the length of the query's
    components with equal signs times the length of the row. The fewer components stand out, the less
    that excludes; a slice of queries that keeps most rows is scored by one matrix product.
    """
    nq, nc = _blocks(queries, query_block), _blocks(corpus, corpus_block)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    pick = lambda df: df.where("embedding is not null").select("vec_id", "embedding")
    q = pick(queries).withColumn("qb", deal(nq)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    c = pick(corpus).withColumn("cb", deal(nc)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def best(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        outs = [pd.DataFrame({"query_id": [], "hit_id": [], "score": []}).astype({"query_id": "int64", "hit_id": "int64", "score": "float64"})]
        if len(left) and len(right):
            ids, own = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
            for at, i, j, s in _within_bound(np.stack(left["embedding"]), np.stack(right["embedding"]), own, ids, k, depth):
                outs.append(pd.DataFrame({"query_id": own[at + i], "hit_id": ids[j], "score": s}))
        return pd.concat(outs)

    return ranked(q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(best, HITS), k)


def _within_bound(left: np.ndarray, right: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, depth: int):
    """Slices ``at, i, j, score`` of the rows ``j`` that no bound keeps from the ``k`` best of query ``at + i``."""
    a, b = _int8(left), _int8(right)
    # a component that rounds to zero adds nothing, whatever its sign
    up, down = (b > 0).astype(np.float64), (b < 0).astype(np.float64)
    length = np.sqrt((b * b).sum(axis=1))
    signs = _signs(right).T
    m = min(max(k, depth), len(ids))
    for at in range(0, len(own), 64):
        x = a[at : at + 64]
        itself = own[at : at + 64, None] == ids[None, :]
        agree = _signs(left[at : at + 64]) @ signs
        agree[itself] = -np.inf
        near = np.argpartition(-agree, m - 1, axis=1)[:, :m]
        seed = np.einsum("qd,qnd->qn", x, b[near])
        seed[np.take_along_axis(itself, near, 1)] = -np.inf
        reached = -np.partition(-seed, min(k, m) - 1, axis=1)[:, min(k, m) - 1]
        bound = np.sqrt(np.where(x > 0, x * x, 0.0) @ up.T + np.where(x < 0, x * x, 0.0) @ down.T) * length
        keep = (bound >= reached[:, None] - 1e-6) & ~itself
        if keep.mean() > 0.2:
            s = x @ b.T
            i, j = np.nonzero(keep & (s >= reached[:, None]))
            yield at, i, j, s[i, j] + 0.0
            continue
        i, j = np.nonzero(keep)
        s = np.einsum("nd,nd->n", x[i], b[j])
        good = s >= reached[i]
        yield at, i[good], j[good], s[good] + 0.0


def self_retrieval(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: ``probes, found``: how many probes have themselves (or an equal vector) as the best hit."""
    top = ranked(candidates(queries, corpus, 1, exclude_self=False), 1)
    own = queries.select(F.col("vec_id").alias("query_id"), F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v).alias("_own"))
    return own.join(top, "query_id", "left").agg(F.count(F.lit(1)).alias("probes"), F.count_if((F.col("hit_id") == F.col("query_id")) | (F.abs(F.col("score") - F.col("_own")) < 1e-6)).alias("found"))
