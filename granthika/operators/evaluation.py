"""Retrieval quality and latency analytics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granthika.session import cut

CUTS = (1, 5, 10, 20)
STAGES = ("stt", "safety", "embed", "search", "fetch", "relevance", "generate", "grounding")
CORE = ("embed", "search", "fetch")
BUDGET_MS = 200.0


def best_per_owner(hits: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, owner, score, rank``: of each owner its best hit, ranked again, the ``k`` best.

    ``hits`` has ``query_id, owner, hit_id, score``; ties by the smaller hit.
    """
    best = hits.groupBy("query_id", "owner").agg(F.max(F.struct("score", (-F.col("hit_id")).alias("neg"))).alias("b"))
    w = Window.partitionBy("query_id").orderBy(F.desc("b.score"), F.desc("b.neg"))
    return best.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("query_id", "owner", F.col("b.score").alias("score"), "rank")


def recall_mrr(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """One row: ``n_queries``, ``recall_at_k`` for each cut, ``mrr`` within the largest.

    ``queries`` has ``query_id``, ``ranked`` ``query_id, doc_id, rank`` (from 0), ``relevant`` ``query_id, doc_id``.
    Recall is the share of queries with at least one relevant hit; a query without any hit counts 0;
    relevant ids are a set.
    """
    first = ranked.where(F.col("rank") < max(cuts)).join(relevant.distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg((F.min("rank") + 1).alias("first"))
    per = queries.select("query_id").distinct().join(first, "query_id", "left")
    at = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in cuts]
    return per.agg(F.count(F.lit(1)).alias("n_queries"), *at, F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def separation(hits: DataFrame) -> DataFrame:
    """``query_id, top1, margin``: the best score and its distance to the mean of the others.

    ``hits`` has ``query_id, score, rank``; scores count in millionths, so that sums are exact in any
    order. A query with one hit has a null margin; hits without a score are left out.
    """
    micro = F.round(F.col("score") * 1_000_000).cast("bigint")
    per = hits.where("score is not null").withColumn("m", micro).groupBy("query_id").agg(F.max_by("m", F.struct((-F.col("rank")).alias("r"), "m")).alias("top"), F.sum("m").alias("s"), F.count(F.lit(1)).alias("n"))
    others = F.col("n") - 1
    over = F.col("top") * others - (F.col("s") - F.col("top"))
    return per.select("query_id", (F.col("top") / 1e6).alias("top1"), F.when(others > 0, over.cast("double") / (others * 1_000_000).cast("double")).alias("margin"))


def stage_times(responses: DataFrame) -> DataFrame:
    """``query_id, stage, ms`` of the timings map; null maps and null times give no row."""
    return responses.select("query_id", F.explode("timings_ms").alias("stage", "ms")).where("ms is not null")


def bucketed(responses: DataFrame, cold: int) -> DataFrame:
    """``responses`` with ``bucket``: the ``cold`` first requests (by id) are cold, the others warm.

    The boundary is one row found by a top-k, not a window over all rows.
    """
    edge = responses.select("query_id").orderBy("query_id").limit(cold).agg(F.max("query_id").alias("edge")).scalar()
    return responses.withColumn("bucket", F.when(F.col("query_id") <= edge, "cold").otherwise("warm"))


def latency_report(responses: DataFrame, cold: int = 20) -> DataFrame:
    """``bucket, stage, n, p50, p70, p100`` by linear interpolation, with the rows ``core`` and ``total``.

    ``core`` sums embedding, search and fetch, and leaves out requests where that is 0. Stages without
    a sample have no row. Percentiles are exact and no task sees more than a range of a stage's times.
    """
    b = bucketed(responses.select("query_id", "timings_ms", "total_ms"), cold)
    t = b.select("bucket", "query_id", F.explode("timings_ms").alias("stage", "ms")).where("ms is not null")
    core = t.where(F.col("stage").isin(*CORE)).groupBy("bucket", "query_id").agg(F.sum("ms").alias("ms")).where("ms > 0").select("bucket", F.lit("core").alias("stage"), "ms")
    total = b.where("total_ms is not null").select("bucket", F.lit("total").alias("stage"), F.col("total_ms").alias("ms"))
    p = percentiles(t.select("bucket", "stage", "ms").unionByName(core).unionByName(total), ["bucket", "stage"], "ms")
    return p.select("bucket", "stage", "n", *[F.round(c, 4).alias(c) for c in ("p50", "p70", "p100")])


def floor_rank(values: Column, percent: float) -> Column:
    """The element at rank ``floor(percent / 100 * n)`` of a sorted array, the last at most; 0 if empty."""
    n = F.size(values)
    at = F.least(n, F.floor(percent / 100 * n) + 1).cast("int")
    return F.when(n > 0, F.get(values, at - 1)).otherwise(F.lit(0.0))


def waterfall(responses: DataFrame) -> DataFrame:
    """``query_id, stage, ms, start_ms``: each stage begins where the ones before it end."""
    order = F.create_map(*[x for i, s in enumerate(STAGES) for x in (F.lit(s), F.lit(i))])
    t = stage_times(responses).where(F.col("stage").isin(*STAGES)).withColumn("_o", order[F.col("stage")])
    w = Window.partitionBy("query_id").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("start_ms", F.round(F.coalesce(F.sum("ms").over(w), F.lit(0.0)), 4)).select("query_id", "stage", "ms", "start_ms")


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` range-partitioned by ``order`` and written once, with ``_range``, the number of the range."""
    return cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def before_ranges(df: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """``_key0.., _range, _before, _all``: of each key and range of ``ranged`` rows the sum of ``n`` in the key's
    ranges before, and in all of them. A key has no more rows here than there are ranges."""
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    w = Window.partitionBy(*[f"_key{i}" for i in range(len(keys))])
    per = df.groupBy(*named, "_range").agg(n.alias("_n"))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.select(*[f"_key{i}" for i in range(len(keys))], "_range", before.alias("_before"), F.sum("_n").over(w).alias("_all"))


def _with_bases(rows: DataFrame, keys: list[str], bases: DataFrame) -> DataFrame:
    """``rows`` with what lies before their range, and in all; null keys are keys like others."""
    on = F.col("_r") == F.col("_range")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return rows.withColumnRenamed("_range", "_r").join(bases, on)


def at_ranks(df: DataFrame, keys: list[str], value: str, picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``keys, n`` and for each of ``picks`` the value at a rank (from 1), which it makes from ``n``; exact, however many
    rows a key has. Null values are left out.

    Equal values are counted before the shuffle; the counts lie in ranges of ``keys, value``, whose sums
    place every value's ranks, so no task sees more than one range.
    """
    counts = ranged(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), *keys, value)
    upto = F.sum("n").over(Window.partitionBy("_range", *keys).orderBy(value))
    at = _with_bases(counts.withColumn("_upto", upto), keys, before_ranges(counts, keys, F.sum("n")))
    last = F.col("_before") + F.col("_upto")
    holds = lambda rank: (rank > last - F.col("n")) & (rank <= last)
    return at.groupBy(*keys).agg(F.max("_all").alias("_all"), *[F.max(F.when(holds(f(F.col("_all"))), F.col(value))).alias(name) for name, f in picks.items()]).withColumnRenamed("_all", "n")


def floor_ranks(df: DataFrame, key: str, value: str, percents: tuple[int, ...] = (50, 70, 100)) -> DataFrame:
    """``key, n, p50, p70, p100``: exact floor-rank percentiles of ``value`` per ``key``."""
    rank = lambda p: lambda n: F.least(n, F.floor(p / 100 * n) + 1)
    return at_ranks(df, [key], value, {f"p{p}": rank(p) for p in percents}).withColumn("n", F.col("n").cast("int"))


def percentiles(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (50, 70, 100)) -> DataFrame:
    """``keys, n, p50, p70, p100``: exact percentiles with linear interpolation between the two neighbouring ranks."""
    place = lambda p, n: (n - 1) * F.lit(p / 100)
    low = lambda p: lambda n: F.floor(place(p, n)) + 1
    high = lambda p: lambda n: F.least(n, F.floor(place(p, n)) + 2)
    picks = {f"_{side}{p}": f(p) for p in percents for side, f in (("low", low), ("high", high))}
    found = at_ranks(df, keys, value, picks)
    between = lambda p: F.col(f"_low{p}") + (F.col(f"_high{p}") - F.col(f"_low{p}")) * (place(p, F.col("n")) - F.floor(place(p, F.col("n"))))
    return found.select(*keys, "n", *[between(p).alias(f"p{p}") for p in percents])


#: rows of one key that one task takes at a time, besides the rows carried over
BLOCK = 20_000


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``_at``, the number of each row (from 0) among its ``key``'s in ``order``, and ``_all``, how many they are.

    Rows are numbered within ranges of ``key, order`` and the ranges' sizes added, so a hot key is no single task's."""
    rows = ranged(df, key, *order)
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy("_range", key).orderBy(*order)) - 1)
    placed = _with_bases(local, [key], before_ranges(rows, [key], F.count(F.lit(1))))
    return placed.select(*df.columns, (F.col("_before") + F.col("_local")).alias("_at"), "_all")


def rolling(hits: DataFrame, key: str, order: list[str], value: str, frame: int = 100, block: int = BLOCK) -> DataFrame:
    """Floor-rank percentiles of the last ``frame`` values per ``key``: ``key, order..., n, p50, p70, p100``.

    The rows of a key are numbered over ranges of ``key, order`` and cut into blocks; the last rows of
    each block are carried over into the next, so a hot key is spread over as many tasks as it has blocks.
    """
    block = max(block, frame)
    at = F.col("_at")
    own = F.floor(at / block)
    carried = F.when((F.pmod(at, F.lit(block)) > block - frame) & ((own + 1) * block < F.col("_all")), F.array(own, own + 1)).otherwise(F.array(own))
    blocks = numbered(hits.where(F.col(value).isNotNull()).select(key, *order, value), key, order).select(key, *order, value, "_at", own.alias("_own"), F.explode(carried).alias("_block"))
    w = Window.partitionBy(key, "_block").orderBy("_at").rowsBetween(-(frame - 1), 0)
    v = blocks.withColumn("_v", F.sort_array(F.collect_list(value).over(w))).where(F.col("_block") == F.col("_own"))
    return v.select(key, *order, F.size("_v").alias("n"), *[floor_rank(F.col("_v"), p).alias(f"p{p}") for p in (50, 70, 100)])
