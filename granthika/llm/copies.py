"""Records that differ only in formatting, collapsed and counted (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from granthika.llm.lines import bare
from granthika.operators.skew import LEAST, MOST, hot_keys, salt
from granthika.session import cut

SALTS = 64
PAYLOAD = StructType([StructField(c, StringType()) for c in ("query_id", "doc_id", "text", "score", "rank", "_bad")])


def text_key(text: Column) -> Column:
    """Canonical key of a text: SHA-256 of its bare form."""
    return F.unhex(F.sha2(bare(text), 256))


def payload_records(raw_hits: DataFrame, payload: str = "payload", rec: str = "log_id") -> DataFrame:
    """``rec`` and ``key`` of every payload that is whole JSON; cut-off and null payloads give no row.

    Numbers are compared as numbers, strings when bare; key order and JSON white space fall away in
    parsing. An absent field and a null one are the same; a null text differs from a blank one.
    """
    p = F.from_json(payload, PAYLOAD, {"columnNameOfCorruptRecord": "_bad"})
    number = lambda c: F.coalesce(F.expr(f"cast(try_cast(p.{c} as double) as string)"), F.col(f"p.{c}"), F.lit("\u0001"))
    word = lambda c: F.coalesce(bare(F.col(f"p.{c}")), F.lit("\u0001"))
    whole = F.col("p").isNotNull() & F.col("p._bad").isNull() & F.coalesce("p.query_id", "p.doc_id", "p.text", "p.score", "p.rank").isNotNull()
    key = F.concat_ws("\u0002", number("query_id"), number("score"), number("rank"), word("doc_id"), word("text"))
    return raw_hits.select(F.col(rec).alias("rec"), p.alias("p")).where(whole).select("rec", F.unhex(F.sha2(key, 256)).alias("key"))


def _groups(records: DataFrame, counts: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representative and count of every hot key (two-level) and of every other key (one-level)."""
    hot = F.broadcast(hot.select("tbl", "key"))
    two = (
        records.join(hot, ["tbl", "key"], "left_semi")
        .groupBy("tbl", "key", salt(F.col("rec"), SALTS).alias("_salt"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("rec").alias("m"))
        .groupBy("tbl", "key")
        .agg(F.sum("c").alias("copies"), F.min("m").alias("keep_key"))
    )
    one = records.join(hot, ["tbl", "key"], "left_anti").groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("copies"), F.min("rec").alias("keep_key"))
    return two, one


def collapse(records: DataFrame, most_hot: int = MOST, least_hot: int = LEAST) -> DataFrame:
    """One row per distinct record: ``tbl, keep_key, copies``.

    ``records`` has ``tbl, key, rec``; further columns are ignored. The representative is the record
    with the smallest ``rec``. Rows whose key is null are left out; a record listed twice counts
    twice. Hot keys, which are found exactly by partial counts merged in a shuffle, are aggregated in
    two levels over a salt, all others in one; of these none holds more than one in ``most_hot`` of the
    rows, and all are combined before the shuffle, so that a task gets one row a key from each other.
    """
    records = cut(records.where(F.col("key").isNotNull()).select("tbl", "key", "rec"))
    counts = records.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("n"))
    two, one = _groups(records, counts, hot_keys(counts, most=most_hot, least=least_hot))
    return two.unionByName(one).select("tbl", "keep_key", "copies")


def copies(records: DataFrame, most_hot: int = MOST, least_hot: int = LEAST) -> DataFrame:
    """Every record that repeats another: ``tbl, keep_key, dup_key``, keep_key < dup_key.

    Same input and cases as ``collapse``. The records of hot keys meet their representative through
    a broadcast (at most ``most_hot`` rows); the others within a window over their own small group.
    """
    records = cut(records.where(F.col("key").isNotNull()).select("tbl", "key", "rec"))
    counts = records.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("n"), F.min("rec").alias("low"))
    hot = hot_keys(counts, most=most_hot, least=least_hot)
    two, _ = _groups(records, counts, hot)
    of_hot = records.join(F.broadcast(two.select("tbl", "key", "keep_key")), ["tbl", "key"])
    repeated = counts.where(F.col("n") > 1).join(F.broadcast(hot.select("tbl", "key")), ["tbl", "key"], "left_anti")
    rest = records.join(repeated.select("tbl", "key", F.col("low").alias("keep_key")), ["tbl", "key"])
    return of_hot.unionByName(rest).where("keep_key < rec").select("tbl", "keep_key", F.col("rec").alias("dup_key")).distinct()
