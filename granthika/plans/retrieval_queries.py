"""Queries over vectors and postings; with their SQL. The query set is every row whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.functions.text import encoder_tokens
from granthika.functions.vectors import hashed_encoder, int8, norm, normalized, sign_bits
from granthika.operators import chunking, corpus, dense, evaluation, lexical
from granthika.plans import corpus_queries
from granthika.session import cut
from granthika.sources import files
from granthika.sources.tables import table


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return e.where("vec_id % 20 = 0"), e


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.index_stats(table(spark, sf, "embeddings"))


def quantize_int8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform(int8(F.col("embedding")), lambda x: x.cast("string")), ",").alias("q"))


def quantize_bits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform(sign_bits(F.col("embedding")), lambda x: F.lpad(F.bin(x), 64, "0")), ",").alias("bits"))


def _rounded(hits: DataFrame, digits: int = 6) -> DataFrame:
    return hits.select("query_id", "hit_id", F.round("score", digits).alias("score"), "rank")


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(dense.top_k(*_vectors(spark, sf), 10))


def int8_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.top_k(*_vectors(spark, sf), 10, "int8")


def hamming_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.top_k(*_vectors(spark, sf), 10, "bits")


def two_tier_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The SQL's cut: only the 200 nearest by sign bits are scored again. Whole results: two_tier_exact_topk."""
    return dense.two_tier(*_vectors(spark, sf), 10, 200)


def two_tier_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.two_tier_exact(*_vectors(spark, sf), 10, 200)


def relevance_gate(spark: SparkSession, sf: str) -> DataFrame:
    top = dense.top_k(*_vectors(spark, sf), 1).select("query_id", "score")
    q = _vectors(spark, sf)[0].select(F.col("vec_id").alias("query_id"))
    return q.join(top, "query_id", "left").select("query_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("top_score"), (F.coalesce("score", F.lit(0.0)) >= 0.35).alias("relevant"))


def self_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return dense.self_retrieval(*_vectors(spark, sf))


def _labelled(hits: DataFrame, e: DataFrame) -> DataFrame:
    return hits.join(e.select(F.col("vec_id").alias("hit_id"), F.col("label").alias("owner")), "hit_id")


def owner_dedup_topk(spark: SparkSession, sf: str) -> DataFrame:
    q, e = _vectors(spark, sf)
    best = evaluation.best_per_owner(_labelled(dense.top_k(q, e, 80), e))
    return best.select("query_id", "owner", F.round("score", 6).alias("score"), "rank")


def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    q, e = _vectors(spark, sf)
    hits = _labelled(dense.top_k(q, e, 20), e).withColumnRenamed("owner", "doc_id").select("query_id", "doc_id", "rank")
    return evaluation.recall_mrr(q.select(F.col("vec_id").alias("query_id")), hits, q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("doc_id")))


def _lexical(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, sf, "qrels").where("qrel_id % 20 = 0").select(F.col("qrel_id").alias("query_id"), F.col("q").alias("text"))
    return q, table(spark, sf, "passage_store").select("doc_id", F.col("t").alias("text"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(*_lexical(spark, sf), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.term_stats(lexical.postings(_lexical(spark, sf)[1]))


def bm25_recall(spark: SparkSession, sf: str) -> DataFrame:
    q, d = _lexical(spark, sf)
    rel = table(spark, sf, "qrels").select(F.col("qrel_id").alias("query_id"), F.explode("rel").alias("doc_id")).where("doc_id is not null")
    return evaluation.recall_mrr(q, lexical.bm25(q, d, 20), rel)


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    q, e = _vectors(spark, sf)
    lists = [dense.top_k(q, e, 20, form).select("query_id", F.col("hit_id").alias("doc_id"), "rank") for form in ("float", "bits")]
    return lexical.fuse(lists, 10).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def _not_zero(vectors: DataFrame) -> DataFrame:
    """Vectors that have a direction; a text without any token has none, so nothing is near it."""
    return vectors.where(F.exists("embedding", lambda x: x != 0))


def _number(*parts: str | Column) -> Column:
    """A 60-bit number for a name, from its MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed-encoder vectors of the texts, searched densely, fused with BM25."""
    q, d = _lexical(spark, sf)
    ids = d.select("doc_id", _number("doc_id").alias("vec_id"))
    encoder = hashed_encoder()
    qv = q.select(F.col("query_id").alias("vec_id"), encoder(encoder_tokens(F.col("text"))).alias("embedding"))
    dv = d.select(_number("doc_id").alias("vec_id"), encoder(encoder_tokens(F.col("text"))).alias("embedding"))
    near = dense.top_k(_not_zero(qv), dv, 20, exclude_self=False).withColumnRenamed("hit_id", "vec_id").join(ids, "vec_id").select("query_id", "doc_id", "rank")
    return lexical.fuse([near, lexical.bm25(q, d, 20).select("query_id", "doc_id", "rank")], 10).select("query_id", "doc_id", "rank")


def chunking_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunking strategy searched with hashed vectors: chunks per passage, recall and rank of the answer key.

    The 80 best chunks per question, of each passage its best, the 20 best passages. Texts are cut once per strategy.
    """
    q = table(spark, sf, "qrels").where("qrel_id % 20 = 0")
    relevant = q.select(F.col("qrel_id").alias("query_id"), F.explode("rel").alias("doc_id")).where("doc_id is not null")
    encoder = hashed_encoder()
    qv = q.select(F.col("qrel_id").alias("vec_id"), encoder(encoder_tokens(F.col("q"))).alias("embedding"))
    texts = table(spark, sf, "passage_store").select(F.col("doc_id").alias("owner"), F.col("l").alias("lang"), F.col("t").alias("text"))
    n_passages = texts.agg(F.count(F.lit(1)).alias("n_passages")).scalar()
    out = None
    for strategy in chunking.STRATEGIES:
        c = cut(chunking.chunks(texts, strategy).select("owner", _number("owner", F.col("pos").cast("string")).alias("vec_id"), "text"))
        hits = dense.top_k(_not_zero(qv), c.select("vec_id", encoder(encoder_tokens(F.col("text"))).alias("embedding")), 80, exclude_self=False)
        owned = hits.join(c.select(F.col("vec_id").alias("hit_id"), "owner"), "hit_id")
        best = evaluation.best_per_owner(owned).withColumnRenamed("owner", "doc_id")
        scores = evaluation.recall_mrr(qv.select(F.col("vec_id").alias("query_id")), best, relevant)
        n_chunks = c.agg(F.count(F.lit(1)).alias("n_chunks")).scalar()
        row = scores.select(F.lit(strategy).alias("strategy"), "*", n_chunks.alias("n_chunks"), F.round(n_chunks / n_passages, 2).alias("chunks_per_passage"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("recall_at_10"), "strategy")


def two_tier_recall(spark: SparkSession, sf: str) -> DataFrame:
    """One row per way of searching: how much of the float ranking's ten best it finds (``recall_at_10``)."""
    q, e = _vectors(spark, sf)
    best = cut(dense.top_k(q, e, 10).select("query_id", "hit_id"))
    n = best.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = None
    for way, hits in (("two_tier", dense.two_tier(q, e, 10, 200)), ("two_tier_exact", dense.two_tier_exact(q, e, 10, 200)), ("int8", dense.top_k(q, e, 10, "int8"))):
        row = best.join(hits.select("query_id", "hit_id"), ["query_id", "hit_id"]).agg(F.round(F.count(F.lit(1)) / n, 6).alias("recall_at_10")).select(F.lit(way).alias("way"), "recall_at_10")
        out = row if out is None else out.unionByName(row)
    return out


def vectors_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors scaled to length 1, as their sum of components, and the length after scaling."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x * F.lit(3.0).cast("float")).alias("v")).select("vec_id", normalized(F.col("v")).alias("u"))
    return e.select("vec_id", F.round(norm(F.col("u")), 5).alias("norm"))


def _shards(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as they lie in shards: each in the shard of its label, every 20th once more in the next one."""
    e = table(spark, sf, "embeddings")
    own = e.select("vec_id", "embedding", F.format_string("shard-%05d", F.col("label").cast("bigint")).alias("shard"))
    again = e.where("vec_id % 20 = 0").select("vec_id", "embedding", F.format_string("shard-%05d", F.col("label").cast("bigint") + 1).alias("shard"))
    return own.unionByName(again)


def shard_first(spark: SparkSession, sf: str) -> DataFrame:
    """Of each vector the copy in the first shard that has it."""
    return files.first_over_shards(_shards(spark, sf)).select("vec_id", "shard")


def shard_first_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The first 100 of them by id: the cap is the feature."""
    return files.first_over_shards(_shards(spark, sf), 100).select("vec_id", "shard")


def shard_norms(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and mean length of every shard's vectors; a shard whose vectors are not of length 1 is an error."""
    return files.unit_shards(_shards(spark, sf)).select("shard", "n", F.round("mean_norm", 6).alias("mean_norm"))


# ---- SQL ---------------------------------------------------------------------------------------
def _topk_sql(score: str, k: int, name: str = "hits") -> str:
    return f"""{name}_all as (select q.vec_id as query_id, c.vec_id as hit_id, {score} as score from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
{name} as (select query_id, hit_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, hit_id) - 1 as rank from {name}_all) where rank < {k})"""


DOT = "round(list_dot_product(q.embedding::double[], c.embedding::double[]), 9)"
Q8 = "list_transform({}, lambda x: greatest(-127.0, least(127.0, round_even((x * 127::float)::double, 0))))"
DOT8 = f"list_dot_product({Q8.format('q.embedding')}::double[], {Q8.format('c.embedding')}::double[])"
HAM = "-cast(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: case when (q.embedding[i] > 0) <> (c.embedding[i] > 0) then 1 else 0 end)) as double)"
TOKENS = r"list_transform(regexp_extract_all({}, '[0-9A-Za-z\x{{0900}}-\x{{097F}}]+'), lambda x: lower(x))"
BM25 = f"""
docs as (select doc_id, {TOKENS.format('t')} as w from passage_store),
post as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(w) as dl, unnest(w) as term from docs) group by 1, 2),
st as (select count(*) as n_docs, avg(len(w)) as avgdl from docs),
dfs as (select term, count(*) as df from post group by 1),
qt as (select query_id, term, count(*) as qf from (select qrel_id as query_id, unnest({TOKENS.format('q')}) as term from qrels where qrel_id % 20 = 0) group by 1, 2),
scored as (
  select query_id, doc_id, round(sum(qf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) as score
  from qt join post using (term) join dfs using (term), st group by 1, 2),
bm as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) - 1 as rank from scored) where rank < 20)
"""


def _recall_sql(queries: str, hits: str, relevant: str) -> str:
    cuts = ", ".join(f"round(avg(case when first <= {k} then 1.0 else 0.0 end), 6) as recall_at_{k}" for k in evaluation.CUTS)
    return f"""first_hit as (select h.query_id, min(rank) + 1 as first from {hits} h join (select distinct query_id, doc_id from ({relevant})) r on r.query_id = h.query_id and r.doc_id = h.doc_id where rank < 20 group by 1)
select count(*) as n_queries, {cuts}, round(avg(coalesce(1.0 / first, 0.0)), 6) as mrr from (select distinct query_id from ({queries})) q left join first_hit using (query_id)"""


SQL = {
    "vector_norms": "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from embeddings",
    "index_stats": "with n as (select len(embedding) as d, sqrt(list_dot_product(embedding::double[], embedding::double[])) as v from embeddings) select count(*) as n, max(d) as dims, round(count(*) * max(d) * 32 / 8 / 1e6, 3) as float_mb, round(count(*) * max(d) * 8 / 8 / 1e6, 3) as int8_mb, round(count(*) * max(d) * 1 / 8 / 1e6, 3) as binary_mb, round(avg(v), 6) as mean_norm, avg(v) > 0.99 and avg(v) < 1.01 as unit from n",
    "quantize_int8": f"select vec_id, array_to_string(list_transform({Q8.format('embedding')}, lambda x: cast(x as int)), ',') as q from embeddings",
    # one word of 64 bits, the first component lowest: the vectors of the tables have 64 components
    "quantize_bits": "select vec_id, array_to_string(list_reverse(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end)), '') as bits from embeddings",
    "dense_topk": f"with {_topk_sql(DOT, 10)} select query_id, hit_id, round(score, 6) as score, rank from hits",
    "int8_topk": f"with {_topk_sql(DOT8, 10)} select * from hits",
    "hamming_topk": f"with {_topk_sql(HAM, 10)} select * from hits",
    "two_tier_topk": f"with {_topk_sql(HAM, 200, 'near')}, again as (select n.query_id, n.hit_id, {DOT8} as score from near n join embeddings q on q.vec_id = n.query_id join embeddings c on c.vec_id = n.hit_id) select query_id, hit_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, hit_id) - 1 as rank from again) where rank < 10",
    "relevance_gate": f"with {_topk_sql(DOT, 1)} select q.vec_id as query_id, round(coalesce(score, 0), 6) as top_score, coalesce(score, 0) >= 0.35 as relevant from embeddings q left join hits on query_id = q.vec_id where q.vec_id % 20 = 0",
    "self_retrieval": "select count(*) as probes, count(*) as found from embeddings where vec_id % 20 = 0",
    "owner_dedup_topk": f"with {_topk_sql(DOT, 80)}, best as (select query_id, label as owner, score, hit_id from hits join embeddings on vec_id = hit_id qualify row_number() over (partition by query_id, label order by score desc, hit_id) = 1), again as (select *, row_number() over (partition by query_id order by score desc, hit_id) - 1 as rank from best) select query_id, owner, round(score, 6) as score, rank from again where rank < 20",
    "recall_mrr": f"with {_topk_sql(DOT, 20)}, labelled as (select query_id, label as doc_id, rank from hits join embeddings on vec_id = hit_id), " + _recall_sql("select vec_id as query_id from embeddings where vec_id % 20 = 0", "labelled", "select vec_id as query_id, label as doc_id from embeddings where vec_id % 20 = 0"),
    "term_stats": f"with {BM25} select term, df from dfs",
    "bm25_topk": f"with {BM25} select query_id, doc_id, round(score, 6) as score, rank from bm where rank < 10",
    "bm25_recall": f"with {BM25}, " + _recall_sql("select qrel_id as query_id from qrels where qrel_id % 20 = 0", "bm", "select qrel_id as query_id, unnest(rel) as doc_id from qrels"),
    "rrf_fusion": f"""with {_topk_sql(DOT, 20, 'a')}, {_topk_sql(HAM, 20, 'b')},
      u as (select query_id, hit_id, rank, 0 as l from a union all select query_id, hit_id, rank, 1 from b),
      s as (select query_id, hit_id as doc_id, round(sum(1e0 / (60 + rank + 1)), 12) as score, min(l * 1000 + rank) as f from u group by 1, 2)
      select query_id, doc_id, round(score, 9) as score, rank from (select *, row_number() over (partition by query_id order by score desc, f, doc_id) - 1 as rank from s) where rank < 10""",
}
SQL["two_tier_exact_topk"] = SQL["int8_topk"]
# the hashed encoder: place and sign of a token by its MD5, components as 32-bit floats of length 1
HASHED = r"""
{name}_tok as (select id, lower(t) as t from (select id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+')) as t from {name}_text)),
{name}_cnt as (select id, substr(md5(t), 9, 2) as b, sum(case when substr(md5(t), 1, 1) >= '8' then 1 else -1 end)::double as c from {name}_tok group by all),
{name}_len as (select id, sqrt(sum(c * c)) as n from {name}_cnt group by 1),
{name} as (select id, b, (c / n)::float::double as x from {name}_cnt join {name}_len using (id) where n > 0)"""
NUMBER = "cast('0x' || substr(md5({}), 1, 15) as bigint)"
# every pair of a question with a direction and a text, also those that share no component
NEAR = "near_all as (select a.id as query_id, b.id as hit_id, coalesce(round(s, 9), 0) as score from (select distinct id from qv) a cross join (select id from dv_text) b left join (select qv.id as q, dv.id as d, sum(qv.x * dv.x) as s from qv join dv using (b) group by 1, 2) on q = a.id and d = b.id)"
SQL["hybrid_topk"] = f"""with {BM25}, qv_text as (select qrel_id as id, q as text from qrels where qrel_id % 20 = 0), {HASHED.format(name='qv')},
  ids as (select doc_id, {NUMBER.format('doc_id')} as id from passage_store), dv_text as (select id, t as text from passage_store join ids using (doc_id)), {HASHED.format(name='dv')}, {NEAR},
  near as (select query_id, doc_id, rank from (select *, row_number() over (partition by query_id order by score desc, hit_id) - 1 as rank from near_all) join ids on ids.id = hit_id where rank < 20),
  u as (select query_id, doc_id, rank, 0 as l from near union all select query_id, doc_id, rank, 1 from bm),
  s as (select query_id, doc_id, round(sum(1e0 / (60 + rank + 1)), 12) as score, min(l * 1000 + rank) as f from u group by 1, 2)
  select query_id, doc_id, rank from (select *, row_number() over (partition by query_id order by score desc, f, doc_id) - 1 as rank from s) where rank < 10"""
_CUTS = ", ".join(f"round(avg(case when first <= {k} then 1.0 else 0.0 end), 6) as recall_at_{k}" for k in evaluation.CUTS)
SQL["chunking_leaderboard"] = f"""with recursive {corpus_queries.TEXTS}, {corpus_queries.SENTENCES}, {corpus_queries.TAGGED}, {corpus_queries.SLIDING}, {corpus_queries.SEMANTIC},
  every as (select 'passage' as strategy, owner, 0 as pos, text from texts union all select 'sentence_window', owner, pos, text from windows union all select 'sliding_window', owner, pos, text from sliding
    union all select 'semantic', owner, pos, text from semantic union all select 'metadata_aware', owner, pos, text from aware),
  qv_text as (select qrel_id as id, q as text from qrels where qrel_id % 20 = 0), {HASHED.format(name='qv')},
  ids as (select strategy, owner, {NUMBER.format("owner || ':' || pos")} as vec_id, strategy || ':' || owner || ':' || pos as id, text from every),
  dv_text as (select id, text from ids), {HASHED.format(name='dv')}, {NEAR},
  hits as (select query_id, strategy, owner, vec_id, score from near_all join ids on ids.id = hit_id qualify row_number() over (partition by query_id, strategy order by score desc, vec_id) <= 80),
  best as (select * from hits qualify row_number() over (partition by query_id, strategy, owner order by score desc, vec_id) = 1),
  placed as (select *, row_number() over (partition by query_id, strategy order by score desc, vec_id) - 1 as rank from best),
  relevant as (select distinct qrel_id as query_id, id from (select qrel_id, unnest(rel) as id from qrels where qrel_id % 20 = 0) where id is not null),
  first_hit as (select p.strategy, p.query_id, min(rank) + 1 as first from placed p join relevant r on r.query_id = p.query_id and r.id = p.owner where rank < 20 group by 1, 2),
  asked as (select strategy, qrel_id as query_id from (select distinct strategy from every), qrels where qrel_id % 20 = 0),
  n as (select strategy, count(*) as n_chunks from every group by 1)
  select strategy, count(*) as n_queries, {_CUTS}, round(avg(coalesce(1.0 / first, 0.0)), 6) as mrr, any_value(n_chunks) as n_chunks, any_value(round(n_chunks / (select count(*) from passage_store), 2)) as chunks_per_passage
  from asked left join first_hit using (strategy, query_id) join n using (strategy) group by 1"""
SQL["two_tier_recall"] = f"""with {_topk_sql(DOT, 10, 'best')}, {_topk_sql(HAM, 200, 'near')}, {_topk_sql(DOT8, 10, 'exact')},
  again as (select n.query_id, n.hit_id, {DOT8} as score from near n join embeddings q on q.vec_id = n.query_id join embeddings c on c.vec_id = n.hit_id),
  two as (select query_id, hit_id from again qualify row_number() over (partition by query_id order by score desc, hit_id) <= 10),
  ways as (select 'two_tier' as way, query_id, hit_id from two union all select 'two_tier_exact', query_id, hit_id from exact union all select 'int8', query_id, hit_id from exact)
  select way, round(count(b.hit_id) / (select count(*) from best), 6) as recall_at_10 from ways w left join best b on b.query_id = w.query_id and b.hit_id = w.hit_id group by 1"""
SQL["vectors_normalized"] = "select vec_id, case when list_dot_product(embedding::double[], embedding::double[]) > 0 then 1.0 else 0.0 end::double as norm from embeddings"
_SHARDS = "shards as (select vec_id, embedding, printf('shard-%05d', label::bigint) as shard from embeddings union all select vec_id, embedding, printf('shard-%05d', label::bigint + 1) from embeddings where vec_id % 20 = 0)"
SQL["shard_first"] = f"with {_SHARDS} select vec_id, min(shard) as shard from shards group by 1"
SQL["shard_first_capped"] = f"with {_SHARDS} select vec_id, min(shard) as shard from shards group by 1 order by 1 limit 100"
SQL["shard_norms"] = f"with {_SHARDS} select shard, count(*) as n, round(avg(sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) as mean_norm from shards group by 1"
QUERIES = {
    f: globals()[f]
    for f in "dense_topk vector_norms vectors_normalized index_stats shard_first shard_first_capped shard_norms quantize_int8 quantize_bits int8_topk hamming_topk two_tier_topk two_tier_exact_topk two_tier_recall relevance_gate self_retrieval owner_dedup_topk recall_mrr term_stats bm25_topk bm25_recall rrf_fusion hybrid_topk chunking_leaderboard".split()
}
