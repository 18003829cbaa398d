"""Building the corpus: first copies, answer keys, counts, limits at row boundaries, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granthika.functions.text import content_id
from granthika.operators.skew import skew_join
from granthika.sources.tables import not_blank, strip

RANGE_ROWS = 100_000


def extracted(rows: DataFrame, column: str = "Translated_passages") -> DataFrame:
    """``row_id, pos, lang, query, text, is_selected``: passages with their flags, white space removed.

    The shorter of the two lists decides how many there are; a missing flag list counts as zeros;
    blank passages are dropped. A null struct gives no row.
    """
    p = F.col("passages")
    texts = p[column]
    flags = F.coalesce(p["is_selected"], F.array_repeat(F.lit(0).cast("bigint"), F.size(texts)))
    n = F.least(F.size(texts), F.size(flags))
    zipped = F.filter(F.arrays_zip(texts.alias("t"), flags.alias("f")), lambda z, i: i < n)
    return (
        rows.where(p.isNotNull() & texts.isNotNull())
        .select("row_id", "lang", "query", F.posexplode(zipped).alias("pos", "z"))
        .where(not_blank(F.col("z.t")))
        .select("row_id", "pos", "lang", "query", strip(F.col("z.t")).alias("text"), F.coalesce("z.f", F.lit(0)).alias("is_selected"))
    )


def first_copies(passages: DataFrame) -> DataFrame:
    """``doc_id, text, lang, row_id, pos``: of equal texts the copy met first (by row, then position).

    The least struct per id is combined before the shuffle, so a text repeated a billion times
    costs one row a task; no window holds its copies.
    """
    first = F.min(F.struct("row_id", "pos", "lang", "text"))
    return passages.groupBy(content_id(F.col("text")).alias("doc_id")).agg(first.alias("f")).select("doc_id", "f.text", "f.lang", "f.row_id", "f.pos")


def new_copies(passages: DataFrame, known: DataFrame) -> DataFrame:
    """``first_copies`` without the ids that ``known`` (``doc_id``) already has."""
    return first_copies(passages).join(known.select("doc_id"), "doc_id", "left_anti")


def answer_key(passages: DataFrame) -> DataFrame:
    """``row_id, q, rel``: ids of the selected passages in order, repeats kept, for non-blank queries."""
    q = strip(F.col("query"))
    return (
        passages.where((F.col("is_selected") != 0) & not_blank(F.col("query")))
        .groupBy("row_id", q.alias("q"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", content_id(F.col("text")).alias("id")))).alias("_r"))
        .select("row_id", "q", F.col("_r.id").alias("rel"))
    )


def counts(passages: DataFrame) -> DataFrame:
    """One row: ``n_rows, raw, unique, dropped, dedup_ratio``; an empty table counts zero of each."""
    per_text = passages.groupBy(content_id(F.col("text")).alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    n_rows = passages.select("row_id").distinct().agg(F.count(F.lit(1)).alias("n_rows")).scalar()
    texts = per_text.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw"), F.count(F.lit(1)).alias("unique"))
    return texts.select(n_rows.alias("n_rows"), "raw", "unique", (F.col("raw") - F.col("unique")).alias("dropped"), (1 - F.col("unique") / F.greatest("raw", F.lit(1))).alias("dedup_ratio"))


def running(df: DataFrame, key: str, value: str, out: str, width: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, in the order of the unique integer ``key``.

    Two levels: sums per range of ``width`` keys, a running sum over those few, and a window within
    each range; no task sees more than one range.
    """
    ranged = df.withColumn("_range", F.floor(F.col(key) / width))
    per_range = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = per_range.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_within", within).join(before, "_range").withColumn(out, F.col("_before") + F.col("_within")).drop("_range", "_within", "_before")


def until(passages: DataFrame, most_passages: int) -> DataFrame:
    """Rows up to and with the one that reaches ``most_passages`` distinct texts: ``row_id, n_new, before``."""
    firsts = first_copies(passages).groupBy("row_id").agg(F.count(F.lit(1)).alias("n_new"))
    per_row = passages.select("row_id").distinct().join(firsts, "row_id", "left").fillna(0, ["n_new"])
    return running(per_row, "row_id", "n_new", "before").where(F.col("before") < most_passages).select("row_id", "n_new", "before")


def slice_for(passages: DataFrame, n_queries: int) -> DataFrame:
    """Distinct passages of the rows visited until ``n_queries`` rows with an answer key were met:
    ``doc_id, text``; rows without a key on the way count as visited."""
    keyed = answer_key(passages).select("row_id", F.lit(1).alias("has"))
    per_row = passages.select("row_id").distinct().join(keyed, "row_id", "left").fillna(0, ["has"])
    visited = running(per_row, "row_id", "has", "before").where(F.col("before") < n_queries).select("row_id")
    return first_copies(passages.join(visited, "row_id", "left_semi")).select("doc_id", "text")


def with_text(hits: DataFrame, store: DataFrame) -> DataFrame:
    """Hits with their passage's text; hits without one are dropped and ranks keep their gaps.

    ``store`` has a row per ``doc_id``; ids that many hits name are spread over salts."""
    return skew_join(hits, store, ["doc_id"], F.struct(*[c for c in hits.columns if c != "doc_id"]))


def index_stats(embeddings: DataFrame) -> DataFrame:
    """One row: ``n, dims, float_mb, int8_mb, binary_mb, mean_norm, unit``."""
    n, d = F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))
    norm = F.avg(F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v)))
    mb = lambda bits: F.round(n * d * bits / 8 / 1e6, 3)
    return embeddings.agg(n.alias("n"), d.alias("dims"), mb(32).alias("float_mb"), mb(8).alias("int8_mb"), mb(1).alias("binary_mb"), F.round(norm, 6).alias("mean_norm"), F.coalesce((norm > 0.99) & (norm < 1.01), F.lit(False)).alias("unit"))


def consistency(hits: DataFrame, store: DataFrame) -> DataFrame:
    """One row: ``refs, ids, ids_without_text``: ids that hits name and the store does not have."""
    named = hits.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    have = store.select("doc_id").distinct().withColumn("have", F.lit(True))
    return named.join(have, "doc_id", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("refs"), F.count(F.lit(1)).alias("ids"), F.count_if(F.col("have").isNull()).alias("ids_without_text"))


def assert_consistent(hits: DataFrame, store: DataFrame) -> DataFrame:
    """``consistency``, which ends in an error when it is read if an id has no text."""
    c = consistency(hits, store)
    wrong = F.raise_error(F.concat(F.col("ids_without_text").cast("string"), F.lit(" ids have no text"))).cast("bigint")
    return c.withColumn("ids_without_text", F.when(F.col("ids_without_text") == 0, F.col("ids_without_text")).otherwise(wrong))


def with_default(df: DataFrame, dimension: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """``df`` with ``value`` looked up in ``dimension`` (``key, value``; one row per key), else ``default``.

    Spark broadcasts the dimension where its size is below the broadcast threshold, and shuffles beyond.
    """
    return df.join(dimension.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def latest(df: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """``key`` and of its last row (by ``order``) the ``values``: an aggregate, so a hot key is combined early."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_l")).select(key, *[F.col(f"_l.{v}").alias(v) for v in values])


def sample_by_hash(df: DataFrame, text: str, n: int) -> DataFrame:
    """``n`` rows in the order of a hash of ``text``: random in effect, the same on every run."""
    return df.where(F.col(text).isNotNull()).orderBy(F.sha2(F.col(text), 256), text).limit(n)
