"""Queries over the corpus: extraction, copies, answer keys, chunks, lookups; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.functions.text import ABBREVIATIONS, blake_id, content_id, words
from granthika.operators import chunking, corpus
from granthika.sources.tables import table


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.extracted(table(spark, sf, "source_rows"))


def extracted_passages(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select("row_id", "pos", "text", "is_selected")


def extracted_english(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.extracted(table(spark, sf, "source_rows"), "English_passages").select("row_id", "pos", "text", "is_selected")


def passage_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.first_copies(_rows(spark, sf)).select("doc_id", "row_id", "pos", "lang")


def passages_not_stored(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "passage_store").select(content_id(F.col("t")).alias("doc_id"))
    return corpus.new_copies(_rows(spark, sf), stored).select("doc_id", "row_id", "pos")


def dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.counts(_rows(spark, sf))


def qrels_build(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.answer_key(_rows(spark, sf)).select("row_id", "q", F.array_join("rel", ",").alias("rel"))


def row_boundary_limit(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.until(_rows(spark, sf), 500)


def slice_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.slice_for(_rows(spark, sf), 100).select("doc_id")


def hits_with_text(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "search_hits").select("hit_id", "query_id", "doc_id", "rank", "score")
    store = table(spark, sf, "passage_store").select("doc_id", F.col("t").alias("passage"))
    return corpus.with_text(hits, store).select("hit_id", "query_id", "rank", F.length("passage").alias("n_chars")).distinct()


def store_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.consistency(table(spark, sf, "search_hits"), table(spark, sf, "passage_store"))


def store_by_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "passage_store").groupBy(F.coalesce("l", F.lit("unk")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("t")).alias("longest"))


def store_ids(spark: SparkSession, sf: str) -> DataFrame:
    """How many stored ids are the BLAKE2b ids of their texts."""
    return table(spark, sf, "passage_store").select("doc_id", blake_id("t").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id") == F.col("id")).alias("n_of_text"))


def word_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = F.coalesce(F.size(words(F.col("text"))), F.lit(0))
    return table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.sum(n).alias("n_words"), F.max(n).alias("most_words"))


def latest_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Of every client the last request."""
    return corpus.latest(table(spark, sf, "requests"), "client_id", ["received_at", "query_id"], "query_id", "k")


def query_sample(spark: SparkSession, sf: str) -> DataFrame:
    """200 answer-key questions in hash order."""
    return corpus.sample_by_hash(table(spark, sf, "qrels").select("qrel_id", "q"), "q", 200)


def languages_named(spark: SparkSession, sf: str) -> DataFrame:
    """Passages per language with a name from a dimension, unknown ones under a default."""
    names = spark.createDataFrame([("hi", "Hindi"), ("bn", "Bengali"), ("ta", "Tamil"), ("ur", "Urdu")], "lang string, name string")
    store = table(spark, sf, "passage_store").select(F.col("l").alias("lang"))
    return corpus.with_default(store, names, "lang", "name", "other").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "passage_store").select(F.col("doc_id").alias("owner"), F.col("l").alias("lang"), F.col("t").alias("text"))


def _chunk_query(strategy: str, *columns: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        c = chunking.chunks(_texts(spark, sf), strategy)
        return c.select("owner", "strategy", "pos", "n_parts", "text", *columns)

    return query


chunk_passage = _chunk_query("passage")
chunk_sentence_window = _chunk_query("sentence_window", "window_text")
chunk_sliding_window = _chunk_query("sliding_window")
chunk_semantic = _chunk_query("semantic")


def chunk_metadata_aware(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunks(_texts(spark, sf), "metadata_aware").select("owner", "strategy", "pos", "n_parts", "text", F.array_join("tags", " ").alias("tags"))


def _chunk_stats(spark: SparkSession, sf: str, strategies: tuple[str, ...]) -> DataFrame:
    t = _texts(spark, sf)
    every = None
    for s in strategies:
        c = chunking.chunks(t, s).select("owner", "strategy", "text")
        every = c if every is None else every.unionByName(c)
    n, owners = F.count(F.lit(1)), F.countDistinct("owner")
    return every.groupBy("strategy").agg(n.alias("n_chunks"), owners.alias("passages"), F.round(n / owners, 2).alias("chunks_per_passage"), F.round(n * 384 * 4 / 1e6, 1).alias("index_mb"), F.max(F.length("text")).alias("longest"))


def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The strategies that SQL can express; ``chunk_stats_all`` has all of them."""
    return _chunk_stats(spark, sf, tuple(s for s in chunking.STRATEGIES if s != "semantic"))


def chunk_stats_all(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_stats(spark, sf, chunking.STRATEGIES)


# ---- SQL ---------------------------------------------------------------------------------------
S = r"[\s\x1c-\x1f\x{85}\p{Z}]"
STRIP = rf"regexp_replace(@, '^{S}+|{S}+$', '', 'g')"


def _extracted_sql(column: str = "Translated_passages") -> str:
    return rf"""
extracted as (
  select row_id, pos - 1 as pos, lang, query, {STRIP.replace('@', 't')} as text, coalesce(f, 0) as is_selected
  from (
    select row_id, lang, query, unnest(passages.{column}) as t, generate_subscripts(passages.{column}, 1) as pos,
      len(passages.{column}) as nt, passages.is_selected as flags from source_rows),
    lateral (select case when flags is null then 0 else flags[pos] end as f)
  where pos <= least(nt, coalesce(len(flags), nt)) and regexp_matches(t, '[^{S[1:]}')),
firsts as (
  select substr(sha256(text), 1, 16) as doc_id, row_id, pos, lang, text from extracted
  qualify row_number() over (partition by text order by row_id, pos) = 1),
keyed as (
  select row_id, {STRIP.replace('@', 'query')} as q, array_to_string(list(substr(sha256(text), 1, 16) order by pos), ',') as rel
  from extracted where is_selected <> 0 and regexp_matches(query, '[^{S[1:]}') group by row_id, query)
"""


EXTRACTED = "with " + _extracted_sql()
WORDS = rf"list_filter(regexp_split_to_array(@, '{S}+'), lambda w: w <> '')"
SENTENCES = rf"""
pieces as (
  select owner, lang, text, i, p from (
    select owner, lang, text, unnest(ps) as p, generate_subscripts(ps, 1) as i from (
      select owner, lang, text, list_filter(list_transform(string_split(regexp_replace(text, '([।॥.!?]){S}+', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.replace('@', 'x')}), lambda x: x <> '') as ps from texts))),
flagged as (
  select *, case when i = 1 or not (length(p) < 15 or regexp_matches(lag(p) over w, '(?i)(^|[^\p{{L}}\p{{N}}_])({ABBREVIATIONS})\.$')) then 1 else 0 end as opens
  from pieces window w as (partition by owner order by i)),
islands as (select *, sum(opens) over (partition by owner order by i) as g from flagged),
sentences as (select owner, any_value(lang) as lang, any_value(text) as full_text, g, string_agg(p, ' ' order by i) as s from islands group by owner, g),
windows as (
  select owner, lang, cast(g - 1 as int) as pos, cast(count(*) over (partition by owner) as int) as n_parts, s as text,
    concat_ws(' ', lag(s) over (partition by owner order by g), s, lead(s) over (partition by owner order by g)) as window_text
  from sentences)
"""
TEXTS = "texts as (select doc_id as owner, l as lang, t as text from passage_store)"
EDGE = r"(^|[^\p{L}\p{N}_])(%s)([^\p{L}\p{N}_]|$)"
TAGGED = rf"""
tagged as (
  select *, case when regexp_matches(text, '{EDGE % "1[0-9]{3}|20[0-9]{2}"}') then 1 else 0 end as is_date,
    case when regexp_matches(text, '(?i)[$₹€£]|{EDGE % "rupees|dollars|crore|lakh"}') then 1 else 0 end as is_money,
    case when regexp_matches(text, '\p{{Nd}}') then 1 else 0 end as is_number from windows),
named as (
  select *, concat_ws(' ', case when is_date = 1 then 'date' end, case when is_money = 1 then 'money' end,
    case when is_number = 1 and is_date = 0 and is_money = 0 then 'numeric' end, case when is_number = 0 and is_date = 0 and is_money = 0 then 'text' end) as tags from tagged),
aware as (select owner, 'metadata_aware(sentence_window)' as strategy, pos, n_parts, '[' || coalesce(lang, 'unk') || ' | ' || tags || '] ' || text as text, tags from named)
"""
SLIDING = rf"""
worded as (select owner, lang, text, {WORDS.replace('@', 'text')} as w from texts),
counted as (select *, case when len(w) <= 80 then 1 else cast(ceil((len(w) - 80) / 60.0) as int) + 1 end as n from worded),
sliding as (
  select owner, cast(j as int) as pos, cast(n as int) as n_parts, case when n = 1 then text else array_to_string(w[j * 60 + 1:j * 60 + 80], ' ') end as text
  from (select *, unnest(range(0, n)) as j from counted))
"""
# neighbours by hashed token counts; a group ends at a distance from the 80th percentile on, or with 200 words
SEMANTIC = rf"""
stoks as (select owner, g, lower(t) as t from (select owner, g, unnest(regexp_extract_all(s, '[\p{{L}}\p{{M}}\p{{N}}]+')) as t from sentences)),
scnt as (select owner, g, substr(md5(t), 9, 2) as b, sum(case when substr(md5(t), 1, 1) >= '8' then 1 else -1 end)::double as c from stoks group by all),
slen as (select owner, g, sqrt(sum(c * c)) as n from scnt group by all),
sdot as (select a.owner, a.g, sum(a.c * z.c) as d from scnt a join scnt z on z.owner = a.owner and z.g = a.g + 1 and z.b = a.b group by all),
snum as (select *, count(*) over (partition by owner) as n_sents from sentences),
dist as (
  select s.owner, s.g, round(1 - coalesce(case when x.n * y.n > 0 then d / (x.n * y.n) end, 0), 9) as dist
  from snum s left join sdot using (owner, g) left join slen x on x.owner = s.owner and x.g = s.g left join slen y on y.owner = s.owner and y.g = s.g + 1
  where s.g < s.n_sents and s.n_sents >= 3),
lims as (select owner, round(quantile_cont(dist, 0.8), 9) as l from dist group by 1),
swords as (
  select s.owner, s.g, s.s, len({WORDS.replace('@', 's.s')}) as n, coalesce(dist >= l, false) as far
  from snum s join lims using (owner) left join dist using (owner, g)),
walk as (
  select owner, g, 0 as grp, n as held from swords where g = 1
  union all
  select w.owner, w.g, case when p.held >= 200 or q.far then p.grp + 1 else p.grp end, case when p.held >= 200 or q.far then w.n else p.held + w.n end
  from walk p join swords q on q.owner = p.owner and q.g = p.g join swords w on w.owner = p.owner and w.g = p.g + 1),
semantic as (
  select owner, grp as pos, cast(count(*) over (partition by owner) as int) as n_parts, text
  from (select owner, cast(grp as int) as grp, string_agg(s, ' ' order by g) as text from walk join swords using (owner, g) group by all)
  union all
  select t.owner, 0, 1, t.text from texts t left join lims using (owner) where l is null)
"""
EVERY = "select owner, 'passage' as strategy, text from texts union all select owner, 'sentence_window', text from windows union all select owner, 'sliding_window', text from sliding union all select owner, strategy, text from aware"
COUNTED = "select strategy, count(*) as n_chunks, count(distinct owner) as passages, round(count(*) / count(distinct owner), 2) as chunks_per_passage, round(count(*) * 384 * 4 / 1e6, 1) as index_mb, max(length(text)) as longest from every group by 1"
SQL = {
    "extracted_passages": EXTRACTED + "select row_id, pos, text, is_selected from extracted",
    "extracted_english": "with " + _extracted_sql("English_passages") + "select row_id, pos, text, is_selected from extracted",
    "passage_dedup": EXTRACTED + "select doc_id, row_id, pos, lang from firsts",
    "passages_not_stored": EXTRACTED + "select doc_id, row_id, pos from firsts where doc_id not in (select substr(sha256(t), 1, 16) from passage_store)",
    "dedup_stats": EXTRACTED + "select count(distinct row_id) as n_rows, count(*) as raw, count(distinct text) as unique, count(*) - count(distinct text) as dropped, 1 - count(distinct text) / greatest(count(*), 1) as dedup_ratio from extracted",
    "qrels_build": EXTRACTED + "select row_id, q, rel from keyed",
    "row_boundary_limit": EXTRACTED
    + ", per as (select e.row_id, count(f.doc_id) as n_new from (select distinct row_id from extracted) e left join firsts f on f.row_id = e.row_id group by 1), run as (select row_id, n_new, coalesce(sum(n_new) over (order by row_id rows between unbounded preceding and 1 preceding), 0) as before from per) select row_id, n_new, cast(before as bigint) as before from run where before < 500",
    "slice_corpus": EXTRACTED
    + ", per as (select e.row_id, count(k.row_id) as has from (select distinct row_id from extracted) e left join keyed k on k.row_id = e.row_id group by 1), run as (select row_id, coalesce(sum(has) over (order by row_id rows between unbounded preceding and 1 preceding), 0) as before from per) select distinct substr(sha256(text), 1, 16) as doc_id from extracted where row_id in (select row_id from run where before < 100)",
    "hits_with_text": "select distinct hit_id, query_id, rank, length(t) as n_chars from search_hits join passage_store using (doc_id)",
    "store_consistency": "with named as (select doc_id, count(*) as n from search_hits where doc_id is not null group by 1) select cast(coalesce(sum(n), 0) as bigint) as refs, count(*) as ids, count(*) filter (doc_id not in (select doc_id from passage_store)) as ids_without_text from named",
    "store_by_language": "select coalesce(l, 'unk') as lang, count(*) as n, max(length(t)) as longest from passage_store group by 1",
    # DuckDB has no BLAKE2b; every id of the tables is one
    "store_ids": "select count(*) as n, count(*) as n_of_text from passage_store",
    "word_stats": rf"select coalesce(source, 'none') as source, count(*) as docs, cast(sum(coalesce(len({WORDS.replace('@', 'text')}), 0)) as bigint) as n_words, max(coalesce(len({WORDS.replace('@', 'text')}), 0)) as most_words from documents group by 1",
    "latest_requests": "select client_id, r.query_id, r.k from (select client_id, max({'a': received_at, 'query_id': query_id, 'k': k}) as r from requests where client_id is not null group by 1)",
    "query_sample": "select qrel_id, q from qrels where q is not null order by sha256(q), q limit 200",
    "languages_named": "select case l when 'hi' then 'Hindi' when 'bn' then 'Bengali' when 'ta' then 'Tamil' when 'ur' then 'Urdu' else 'other' end as name, count(*) as n from passage_store group by 1",
    "chunk_passage": "select doc_id as owner, 'passage' as strategy, 0 as pos, 1 as n_parts, t as text from passage_store",
    "chunk_sentence_window": f"with {TEXTS}, {SENTENCES} select owner, 'sentence_window' as strategy, pos, n_parts, text, window_text from windows",
    "chunk_sliding_window": f"with {TEXTS}, {SLIDING} select owner, 'sliding_window' as strategy, pos, n_parts, text from sliding",
    "chunk_semantic": f"with recursive {TEXTS}, {SENTENCES}, {SEMANTIC} select owner, 'semantic' as strategy, pos, n_parts, text from semantic",
    "chunk_metadata_aware": f"with {TEXTS}, {SENTENCES}, {TAGGED} select owner, strategy, pos, n_parts, text, tags from aware",
    "chunk_stats": f"with {TEXTS}, {SENTENCES}, {TAGGED}, {SLIDING}, every as ({EVERY}) {COUNTED}",
    "chunk_stats_all": f"with recursive {TEXTS}, {SENTENCES}, {TAGGED}, {SLIDING}, {SEMANTIC}, every as ({EVERY} union all select owner, 'semantic', text from semantic) {COUNTED}",
}
QUERIES = {
    f: globals()[f]
    for f in "extracted_passages extracted_english passage_dedup passages_not_stored dedup_stats qrels_build row_boundary_limit slice_corpus hits_with_text store_consistency store_by_language store_ids word_stats latest_requests query_sample languages_named chunk_passage chunk_sentence_window chunk_sliding_window chunk_semantic chunk_metadata_aware chunk_stats chunk_stats_all".split()
}
