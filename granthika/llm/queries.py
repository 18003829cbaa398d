"""The pN_ queries of the llm operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.llm.align import aligned
from granthika.llm.copies import collapse, copies, payload_records, text_key
from granthika.llm.encoding import restore
from granthika.llm.lookalike import consistent, look_alikes
from granthika.llm.mixing import mixture, shares
from granthika.llm.neardup import near_groups, near_pairs
from granthika.llm.packing import CAPACITY, documents_in_containers
from granthika.llm.sentences import sentences
from granthika.llm.splitting import pieces
from granthika.session import cut
from granthika.sources.tables import SPACE, not_blank, passages, response_passages, strip, table

#: near-duplicates here: runs of three words, similarity 0.6 (TESTDATA.md)
WIDTH, SIMILARITY = 3, 0.6


def p1_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(passages(table(spark, sf, "source_rows")), "text", "pkey", "lang", lang="lang")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(passages(table(spark, sf, "source_rows")), "text", "pkey", lang="lang").select("pkey", F.col("start_char").cast("bigint").alias("start_char"))


def _near_texts(spark: SparkSession, sf: str) -> DataFrame:
    own = passages(table(spark, sf, "source_rows")).select(F.lit("source_rows").alias("tbl"), F.lit(-1).cast("bigint").alias("scope"), F.col("pkey").alias("key"), "text")
    inside = response_passages(table(spark, sf, "responses")).select(F.lit("responses").alias("tbl"), F.col("query_id").alias("scope"), F.col("okey").alias("key"), "text")
    return own.unionByName(inside)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_pairs(_near_texts(spark, sf), WIDTH, SIMILARITY)


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_groups(_near_texts(spark, sf), WIDTH, SIMILARITY)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    own = passages(table(spark, sf, "source_rows")).select(F.lit("source_rows").alias("tbl"), F.col("pkey").alias("rec"), text_key(F.col("text")).alias("key"))
    return own.unionByName(payload_records(table(spark, sf, "raw_hits")).select(F.lit("raw_hits").alias("tbl"), "rec", "key"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies(_records(spark, sf))


def p3_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return collapse(_records(spark, sf))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    own = passages(table(spark, sf, "source_rows")).select(F.lit("source_rows").alias("tbl"), F.col("pkey").alias("rec_id"), "text")
    stored = table(spark, sf, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("rec_id"), "text")
    return pieces(own.unionByName(stored), "text", "tbl", "rec_id")


def _long_texts(spark: SparkSession, sf: str) -> DataFrame:
    own = passages(table(spark, sf, "source_rows")).select(F.lit("source_rows").alias("tbl"), F.col("pkey").alias("rec_id"), "text")
    return own.unionByName(table(spark, sf, "chunks").where(not_blank(F.col("text"))).select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("rec_id"), "text"))


def p4_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per table: texts, long ones, pieces beyond the limit, pieces that repeat more than the overlap, and texts that their
    pieces without the repeats do not give back (white space aside)."""
    p = p4_pieces(spark, sf)
    part = F.struct("piece_no", F.expr("substring(piece, core_char - start_char + 1)").alias("t"))
    per = p.groupBy("tbl", "rec_id").agg(
        F.count_if(F.col("end_char") - F.col("start_char") > 800).alias("too_long"),
        F.count_if(F.col("core_char") - F.col("start_char") > 100).alias("repeats"),
        F.array_join(F.sort_array(F.collect_list(part))["t"], "").alias("again"),
    )
    bare_of = lambda c: F.regexp_replace(c, SPACE + "+", "")
    both = _long_texts(spark, sf).join(per, ["tbl", "rec_id"], "left")
    unlike = F.coalesce(bare_of(F.col("again")) != bare_of(F.col("text")), F.lit(True))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.groupBy("tbl").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.length(strip(F.col("text"))) > 800).alias("long_texts"), n("too_long").alias("too_long"), n("repeats").alias("long_repeats"), F.count_if(unlike).alias("not_given_back"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_pieces(spark, sf).where("piece_no = 1").select("tbl", "rec_id")


def _looks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = passages(table(spark, sf, "source_rows")).select(F.lit("source_rows").alias("tbl"), F.col("pkey").alias("rec_id"), strip(F.col("text")).alias("text"))
    asked = table(spark, sf, "requests").select(F.lit("requests").alias("tbl"), F.col("query_id").alias("rec_id"), "text")
    stored = table(spark, sf, "passage_store").select(F.lit("source_rows").alias("tbl"), F.col("doc_id").alias("match_id"), F.col("t").alias("text"))
    keys = table(spark, sf, "qrels").select(F.lit("requests").alias("tbl"), F.col("qrel_id").cast("string").alias("match_id"), F.col("q").alias("text"))
    return own.unionByName(asked), stored.unionByName(keys)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return look_alikes(*_looks(spark, sf))


def p6_canonical(spark: SparkSession, sf: str) -> DataFrame:
    texts, stored = _looks(spark, sf)
    return consistent(texts, stored, "tbl", "rec_id").select("tbl", "rec_id", "canonical")


def p7_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return aligned(table(spark, sf, "source_rows"), table(spark, sf, "glossary"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_pairs(spark, sf).select("pkey", F.col("en_start").cast("bigint").alias("en_start"), F.col("tr_start").cast("bigint").alias("tr_start"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return documents_in_containers(table(spark, sf, "documents"))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """One row: documents in containers, containers beyond the capacity, documents split without need, and documents of
    which a piece is in several containers or missing."""
    c = cut(documents_in_containers(table(spark, sf, "documents")))
    over = c.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > CAPACITY).alias("over")).scalar()
    per = c.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.count_distinct("piece_no").alias("pieces"), F.max("piece_no").alias("last"))
    return per.agg(F.count(F.lit(1)).alias("docs"), over.alias("overfull"), F.count_if((F.col("n") > 1) & (F.col("t") <= CAPACITY)).alias("split_without_need"), F.count_if((F.col("n") != F.col("pieces")) | (F.col("last") != F.col("n") - 1)).alias("not_whole"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shares(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_checks(spark: SparkSession, sf: str) -> DataFrame:
    """One row: sources drawn from, copies from sources without a target, documents used too often or with a copy missing."""
    t = table(spark, sf, "mix_targets").groupBy("source").agg(F.max("max_repeats").alias("most"))
    per = mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), (F.max("copy_no") + 1).alias("copies"))
    joined = per.groupBy("source").agg(F.max("n").alias("n"), F.count_if(F.col("n") != F.col("copies")).alias("gaps")).join(t, "source", "left")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return joined.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("most").isNull()).alias("without_target"), F.count_if(F.col("n") > F.col("most")).alias("used_too_often"), n("gaps").alias("gaps"))


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    return restore(table(spark, sf, "documents"), "text", "doc_id").select("doc_id", "restored_text", "steps", "lost")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return restore(table(spark, sf, "documents"), "text", "doc_id").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_sentences, p2_found, p2_groups, p3_found, p3_collapsed, p4_found, p4_pieces, p4_checks, p6_found, p6_canonical, p7_found, p7_pairs, p8_containers, p8_checks, p9_mixture, p9_shares, p9_checks, p10_found, p10_restored)}
