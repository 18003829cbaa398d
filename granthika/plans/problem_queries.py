"""Registered queries of the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.operators.orphans import orphan_report, orphans
from granthika.sources.tables import table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "qrels").select(F.lit("qrels").alias("tbl"), F.col("qrel_id").alias("rec_id"), F.explode("rel").alias("doc_id"), F.col("written_at").alias("at"))
    hits = table(spark, sf, "search_hits").select(F.lit("search_hits").alias("tbl"), F.col("hit_id").alias("rec_id"), "doc_id", F.col("searched_at").alias("at"))
    return orphans(keys.unionByName(hits), table(spark, sf, "passage_store").select("doc_id", "stored_at", "deleted_at"))


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(p5_found(spark, sf))


P5 = r"""
with refs as (
  select 'qrels' as tbl, qrel_id as rec_id, unnest(rel) as id, written_at as ts from qrels
  union all select 'search_hits', hit_id, doc_id, searched_at from search_hits),
r as (select tbl, rec_id, regexp_replace(lower(id), '[\s\x1c-\x1f\x{85}\p{Z}\p{P}]+', '', 'g') as doc_id, ts from refs where id is not null and ts is not null),
found as (
  select distinct tbl, strftime(ts, '%Y-%m') as period, rec_id, r.doc_id,
    case when p.doc_id is null then 'missing' when stored_at > ts then 'late' else 'deleted' end as reason
  from r left join passage_store p on p.doc_id = r.doc_id
  where r.doc_id <> '' and (p.doc_id is null or stored_at > ts or deleted_at <= ts))
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": P5 + "select * from found",
    "p5_report": P5 + "select tbl, period, reason, count(*) as refs, count(distinct doc_id) as ids from found group by all",
}
