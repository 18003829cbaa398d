"""References without a record at their time (problem 5), by bitmaps over dictionary-encoded keys.

Keys become integers: a hash bucket and the rank within it, so that the codes of a bucket are dense.
Bitmaps are kept per table, period and range of 16,384 codes; a range is one value, which holds those of its
64-bit words that have a bit set and no others. A parent's bitmap has the keys that exist during
the whole of a period. Reference AND NOT parent leaves the keys that may fail in that period; their
bits are decoded, and only the references to these keys are compared with the parents' exact times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granthika.operators.skew import LEAST, MOST, hot_keys
from granthika.session import cut

DROPPED = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{P}]+"
#: keys in a bucket of the dictionary, about
PER_BUCKET = 20_000
#: 64-bit words in a range
WORDS = 256


def bare_id(c: Column) -> Column:
    """An id in the form in which ids are compared: lower case, without white space and punctuation."""
    return F.regexp_replace(F.lower(c), DROPPED, "")


def dictionary(keys: DataFrame, buckets: int) -> DataFrame:
    """``key, code`` for the distinct non-null ``key`` values; the same keys always get the same codes.

    ``code`` is ``bucket * 2**32 + rank``: no driver-side counter, and no task holds more than one
    hash bucket of distinct keys.
    """
    b = F.pmod(F.xxhash64("key"), F.lit(buckets))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("key")) - 1
    return keys.select("key").where("key is not null").distinct().withColumn("_b", b).select("key", (F.col("_b") * (1 << 32) + rank).alias("code"))


def bitmap(codes: DataFrame, *by: str) -> DataFrame:
    """The bitmap of ``code`` per ``by``: ``by..., range, words``, the words in use of each range by their place.

    Words are made by a bitwise OR, combined before the shuffle, so a hot key costs one word a task; a
    range has at most ``WORDS`` of them.
    """
    words = codes.groupBy(*by, F.expr("shiftright(code, 6)").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(code & 63 as int)))").alias("_bits"))
    entry = F.struct(F.pmod("_word", F.lit(WORDS)).cast("smallint").alias("at"), F.col("_bits").alias("bits"))
    return words.groupBy(*by, F.floor(F.col("_word") / WORDS).alias("range")).agg(F.map_from_entries(F.collect_list(entry)).alias("words"))


def and_not(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """The bits of ``left`` that ``right`` has not, per ``by`` and range; words and ranges without any fall away."""
    r = right.withColumnRenamed("words", "_other")
    without = F.expr("map_filter(transform_values(words, (at, bits) -> bits & ~coalesce(_other[at], 0L)), (at, bits) -> bits <> 0)")
    return left.join(r, [*by, "range"], "left").select(*left.columns[:-1], without.alias("words")).where(F.size("words") > 0)


def decode(ranges: DataFrame, *keep: str) -> DataFrame:
    """``keep..., code`` for every bit set."""
    words = ranges.select(*keep, "range", F.explode("words").alias("_at", "_bits"))
    bits = words.select(*keep, (F.col("range") * WORDS + F.col("_at")).alias("_word"), F.explode(F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(_bits, b) & 1) = 1)")).alias("_bit"))
    return bits.select(*keep, F.expr("shiftleft(_word, 6) | _bit").alias("code"))


def orphans(references: DataFrame, parents: DataFrame, buckets: int | None = None, most_hot: int = MOST, least_hot: int = LEAST) -> DataFrame:
    """Failing references: ``tbl, period, rec_id, doc_id, reason``, each once.

    ``references`` has ``tbl, rec_id, doc_id, at``, ``parents`` ``doc_id, stored_at, deleted_at``; ids are
    compared when bare. A parent exists from ``stored_at`` (included; null: always) to ``deleted_at``
    (excluded; null: for good); of several parents with one id any that exists will do. ``reason`` is
    ``missing`` (no such id), ``late`` (each of its parents is stored only later) or ``deleted``.
    References with a null id or a null time, or an id that is blank when bare, are not reported;
    repeated ones come out once; further columns are ignored.
    """
    refs = references.select("tbl", "rec_id", bare_id(F.col("doc_id")).alias("key"), F.col("at"), F.date_format("at", "yyyy-MM").alias("period")).where("key <> '' and at is not null")
    own = parents.select(bare_id(F.col("doc_id")).alias("key"), "stored_at", "deleted_at").where("key <> ''")
    used = cut(refs.groupBy("tbl", "period", "key").agg(F.count(F.lit(1)).alias("n")))
    # keys that no record refers to need no code
    codes = cut(dictionary(used.select("key"), buckets or 1 + used.count() // PER_BUCKET))
    coded = used.join(codes, "key")
    # the months through which a parent exists as a whole, between the first and the last with a reference
    month = lambda which: F.to_date(F.concat(used.agg(which("period").alias("p")).scalar(), F.lit("-01")))
    begin = F.when(F.col("stored_at") <= F.trunc("stored_at", "month").cast("timestamp_ntz"), F.trunc("stored_at", "month")).otherwise(F.add_months(F.trunc("stored_at", "month"), 1))
    first, last = F.greatest(begin, month(F.min)), F.least(F.add_months(F.trunc("deleted_at", "month"), -1), month(F.max))
    through = (
        own.join(codes, "key")
        .select("code", first.alias("_first"), last.alias("_last"))
        .where("_first <= _last")
        .select("code", F.explode(F.expr("sequence(_first, _last, interval 1 month)")).alias("_month"))
        .select("code", F.date_format("_month", "yyyy-MM").alias("period"))
    )
    left = decode(and_not(bitmap(coded, "tbl", "period"), bitmap(through, "period"), "period"), "tbl", "period")
    suspects = left.join(coded, ["tbl", "period", "code"]).select("tbl", "period", "key", "n")
    times = own.groupBy("key").agg(F.collect_set(F.struct("stored_at", "deleted_at")).alias("lives"))
    suspects = cut(suspects.join(times, "key", "left"))
    # references to hot keys, failing or not, meet their few suspects by broadcast and are shuffled nowhere
    on = ["tbl", "period", "key"]
    hot = F.broadcast(hot_keys(used, most=most_hot, least=least_hot).select(*on))
    hot_side, rest_side = (suspects.join(hot, on, how).drop("n") for how in ("left_semi", "left_anti"))
    met = refs.join(F.broadcast(hot_side), on).unionByName(refs.join(hot, on, "left_anti").join(rest_side, on))
    gone = F.expr("not exists(lives, x -> (x.stored_at is null or x.stored_at <= at) and (x.deleted_at is null or x.deleted_at > at))")
    late = F.expr("forall(lives, x -> x.stored_at > at)")
    return (
        met.where(F.col("lives").isNull() | gone)
        .withColumn("reason", F.when(F.col("lives").isNull(), "missing").when(late, "late").otherwise("deleted"))
        .select("tbl", "period", "rec_id", F.col("key").alias("doc_id"), "reason")
        .distinct()
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Failing references counted: ``tbl, period, reason, refs, ids``."""
    per_id = found.groupBy("tbl", "period", "reason", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy("tbl", "period", "reason").agg(F.sum("n").alias("refs"), F.count(F.lit(1)).alias("ids"))
