"""Hot keys: found exactly by count, joined and aggregated apart from the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a key of one in so many rows is hot, so there are never more hot keys than that
MOST = 1000
#: and of at least so many rows: fewer are no burden for any task
LEAST = 64
SALTS = 32


def hot_keys(counts: DataFrame, n: str = "n", most: int = MOST, least: int = LEAST) -> DataFrame:
    """The rows of ``counts`` whose ``n`` makes their key hot.

    ``counts`` has one row per key with its exact count. A key is hot if it holds at least one in
    ``most`` of all rows and at least ``least`` rows; so there are never more than ``most`` hot keys,
    which is the bound under which they may be broadcast. An empty table has no hot key.
    """
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total")).scalar()
    return counts.where(F.col(n) >= F.greatest(F.lit(least), F.ceil(total / most)))


def salt(of: Column, parts: int) -> Column:
    """A salt from 0 to ``parts - 1`` that depends on the row only, so a retried task salts alike."""
    return F.pmod(F.xxhash64(of), F.lit(parts)).cast("int")


def skew_join(big: DataFrame, small: DataFrame, on: list[str], by: Column, counts: DataFrame | None = None, how: str = "inner", salts: int = SALTS, most: int = MOST, least: int = LEAST) -> DataFrame:
    """``big`` joined with ``small`` on ``on``, where single keys may hold a large part of ``big``.

    Rows of hot keys are dealt over ``salts`` by ``by``, a column that tells a key's rows apart, and
    the rows that ``small`` has for these keys (few per key) are repeated for each salt; all other
    keys are shuffled once. ``counts`` has ``on`` and ``n``, the rows of each key in ``big``, and is made if
    not given. ``how`` is inner or left_semi; a null key meets nothing.
    """
    if counts is None:
        counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(hot_keys(counts, most=most, least=least).select(*on, F.lit(True).alias("_hot")))
    known = lambda df: df.where(" and ".join(f"`{c}` is not null" for c in on)).join(hot, on, "left")
    dealt = known(big).withColumn("_salt", F.when(F.col("_hot"), salt(by, salts)).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = known(small).withColumn("_salt", F.explode(every)).drop("_hot")
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")
