"""Mixing sources to target shares (problem 9), by systematic sampling.

Every document of a source is expected as often as its source's rate says; the expected copies are
summed up along an order, one random offset per source is added, and a document is put out once
for every whole number that its stretch of the sum crosses. The order goes by size, so that each
stretch of sizes is drawn at the same rate and the token totals stay close to what is expected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granthika.llm.tokens import TOKENIZER, token_count
from granthika.operators.skew import skew_join
from granthika.session import cut

MOST_SOURCES = 10_000
#: documents of one source and size that one task numbers, about
PER_BUCKET = 20_000
#: pairs of a source and a size class up to which their counts are broadcast
FEW_CLASSES = 100_000


def rates(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """``source, target_share, max_repeats, docs, tokens, rate``: expected copies per document.

    ``sized`` has ``source, n_tokens``. The shares of sources without documents cannot be reached; the
    others keep their proportions. Without ``total_tokens`` the total is the largest at which every
    one of them reaches its target; with it, rates are cut off at ``max_repeats``. Targets with a null
    source, no share, or no allowed use are not drawn; a source listed twice counts once, with the
    sum of its shares.
    """
    t = targets.where("source is not null").groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    have = sized.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    r = t.join(have, "source", "left").fillna(0, ["docs", "tokens"])
    can = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    reachable = r.where(can).agg(F.sum("target_share").alias("s")).scalar()
    per_share = r.where(can).agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("t")).scalar()
    total = F.lit(float(total_tokens)) if total_tokens is not None else per_share * reachable
    rate = total * F.col("target_share") / reachable / F.col("tokens")
    return r.select("source", "target_share", "max_repeats", "docs", "tokens", F.when(can, F.least(rate, F.col("max_repeats").cast("double"))).otherwise(0.0).alias("rate"))


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 42, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, copy_no, n_tokens``, a row per copy (from 0) in the mixture.

    ``documents`` has ``doc_id, source, text``. Null and empty texts have no tokens and are not drawn, nor
    are documents without a source or whose source has no target. No document comes out more than
    its source's ``max_repeats`` times; repeated rows count as documents of their own. The same seed
    gives the same mixture.
    """
    sized = cut(documents.where("source is not null and text <> ''").select("doc_id", "source", token_count(tokenizer)("text").alias("n_tokens")).where("n_tokens > 0"))
    return draw(sized, cut(rates(sized, targets, total_tokens)), seed).select("doc_id", "source", "copy_no", "n_tokens")


def draw(sized: DataFrame, rate: DataFrame, seed: int = 42, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Copies of ``sized`` (``doc_id, source, n_tokens``) by ``rate`` (``source, rate``).

    The running sum is taken in two levels: within buckets of a source (a size class and a hash), and
    over the buckets' totals. A size class has as many buckets as it takes for about ``per_bucket`` documents
    each, so a source that holds most of the documents is spread over many tasks, and a task never has more.
    """
    if rate.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    size_class = F.floor(F.log2(F.col("n_tokens").cast("double")) * 8).cast("int")
    drawn = sized.join(F.broadcast(rate.where("rate > 0").select("source", "rate")), "source").withColumn("_class", size_class)
    classes = cut(drawn.groupBy("source", "_class").agg(F.count(F.lit(1)).alias("n")))
    buckets = classes.select("source", "_class", F.ceil(F.col("n") / per_bucket).alias("_buckets"))
    if classes.limit(FEW_CLASSES + 1).count() <= FEW_CLASSES:
        placed = drawn.join(F.broadcast(buckets), ["source", "_class"])
    else:
        placed = skew_join(drawn, buckets, ["source", "_class"], F.col("doc_id"), classes)
    with_rate = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("_buckets"))).withColumn("_order", F.xxhash64(F.lit(seed), "doc_id")).drop("_buckets")
    # counted in whole documents, so that the buckets' edges meet exactly
    totals = with_rate.groupBy("source", "_class", "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    over = Window.partitionBy("source").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) / float(1 << 30)
    starts = totals.select("source", "_class", "_bucket", F.coalesce(F.sum("_count").over(over), F.lit(0)).alias("_before"), offset.alias("_offset"))
    within = Window.partitionBy("source", "_class", "_bucket").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = with_rate.withColumn("_rank", F.row_number().over(within)).join(starts, ["source", "_class", "_bucket"])
    edge = lambda k: F.floor(F.col("_offset") + (F.col("_before") + k) * F.col("rate"))
    copies = (edge(F.col("_rank")) - edge(F.col("_rank") - 1)).cast("int")
    return placed.withColumn("_n", copies).where("_n > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy_no"))


def shares(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 42, tokenizer: str = TOKENIZER) -> DataFrame:
    """The shares reached: ``source, target_share, share, tokens, copies, docs_available, most_copies, max_repeats``.

    One row per target source, those that nothing could be drawn for with a share of 0.
    """
    sized = cut(documents.where("source is not null and text <> ''").select("doc_id", "source", token_count(tokenizer)("text").alias("n_tokens")).where("n_tokens > 0"))
    rate = cut(rates(sized, targets, total_tokens))
    drawn = draw(sized, rate, seed).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), (F.max("copy_no") + 1).alias("most_copies"))
    total = Window.partitionBy()
    # one row per target source: the window over all of them is as small as the list of targets
    return (
        rate.drop("tokens").join(drawn, "source", "left")
        .fillna(0, ["tokens", "copies", "most_copies"])
        .withColumn("share", F.coalesce(F.col("tokens") / F.sum("tokens").over(total), F.lit(0.0)))
        .select("source", "target_share", "share", "tokens", "copies", F.col("docs").alias("docs_available"), "most_copies", "max_repeats")
    )
