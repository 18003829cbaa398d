"""Queries over requests, responses, hits and events: screening, grounding, latency, event contracts; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.functions.text import HARM, INJECTION, LABELS, STOPWORDS, grounding, normalize_answer, numbered_context, screen, tokens, violations
from granthika.functions import wire
from granthika.operators import evaluation
from granthika.plans.corpus_queries import STRIP, S
from granthika.sources.files import QRELS
from granthika.sources.tables import strip, table
from granthika.streaming import events

FLOOR, GROUNDED = 0.80, 0.8
EVENT_TYPES = ("view", "click", "signup", "purchase", "error")


def safety_screen(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "requests").select("query_id", screen(F.col("text")).alias("screen")).distinct()


def screen_counts(spark: SparkSession, sf: str) -> DataFrame:
    return safety_screen(spark, sf).groupBy("screen").agg(F.count(F.lit(1)).alias("n"))


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "responses").where("answer is not null")
    context = F.array_distinct(F.flatten(F.transform(F.coalesce("passages", F.array()), lambda p: tokens(p["text"]))))
    answer = normalize_answer(F.col("answer"))
    return r.select("query_id", answer.alias("a"), context.alias("c")).select("query_id", grounding(F.col("a"), F.col("c")).alias("score"), violations(F.col("a"), F.col("c")).alias("bad"))


def answer_grounding(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.col("bad")
    return _checked(spark, sf).select("query_id", F.round("score", 6).alias("score"), F.array_join(bad, ", ").alias("unsupported"), ((F.col("score") >= GROUNDED) & (F.size(bad) == 0)).alias("grounded"))


def grounding_detail(spark: SparkSession, sf: str) -> DataFrame:
    """The score and the first five unsupported tokens."""
    return _checked(spark, sf).where(F.size("bad") > 0).select("query_id", F.array_join(F.slice("bad", 1, 5), ", ").alias("first_five"), F.size("bad").alias("n_bad"))


def answers_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "responses").where("answer is not null").select("query_id", normalize_answer(F.col("answer")).alias("answer"))


def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "responses").where("passages is not null and query is not null")
    return r.select("query_id", F.md5(numbered_context(F.transform("passages", lambda p: F.coalesce(p["text"], F.lit(""))), F.col("query"))).alias("prompt_md5"))


def relevance_floor(spark: SparkSession, sf: str) -> DataFrame:
    top = F.coalesce("top_score", F.lit(0.0)) >= FLOOR
    return table(spark, sf, "responses").groupBy(top.alias("relevant")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("top_score"), 6).alias("mean_top"))


def refusal_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "responses").where("refused").groupBy(F.coalesce("refusal_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def latency_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.latency_report(table(spark, sf, "responses"), 20)


def latency_floor_rank(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.floor_ranks(table(spark, sf, "responses"), "refused", "total_ms")


def stage_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.waterfall(table(spark, sf, "responses"))


def budget_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Time of the own stages and of remote ones per request, and whether the own ones keep the budget."""
    t = evaluation.stage_times(table(spark, sf, "responses"))
    own = F.col("stage").isin("safety", "embed", "search", "fetch", "relevance", "grounding")
    per = t.groupBy("query_id").agg(F.round(F.sum(F.when(own, F.col("ms")).otherwise(0.0)), 4).alias("own_ms"), F.round(F.sum(F.when(own, 0.0).otherwise(F.col("ms"))), 4).alias("remote_ms"))
    return per.withColumn("in_budget", F.col("own_ms") <= evaluation.BUDGET_MS)


def rolling_history(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return evaluation.rolling(e, "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "n", "p50", "p70", "p100")


def event_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    p = evaluation.percentiles(table(spark, sf, "events"), ["event_type"], "value")
    return p.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p70", "p100")])


def score_separation(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "search_hits").select("hit_id", "query_id", "score", "rank").distinct()
    return evaluation.separation(hits.where("query_id is not null"))


def hit_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval quality of the logged hits against the answer key, for requests that are in it."""
    key = table(spark, sf, "qrels").select("q", "rel")
    asked = table(spark, sf, "requests").where("text is not null").select("query_id", strip(F.col("text")).alias("q")).distinct().join(key, "q")
    hits = table(spark, sf, "search_hits").where("query_id is not null and doc_id is not null").select("query_id", "doc_id", "rank")
    return evaluation.recall_mrr(asked, hits, asked.select("query_id", F.explode("rel").alias("doc_id")).where("doc_id is not null"))


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The logged events of every user, numbered in their order."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return evaluation.numbered(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("_at").alias("seq"), "event_type")


def event_contract(spark: SparkSession, sf: str) -> DataFrame:
    """The logged events of each user and day: how many, whether all types are known, the first and the last one, whether
    something went wrong behind the last purchase, and how the day ended."""
    e = table(spark, sf, "events").where("user_id is not null and ts is not null")
    at = F.struct("ts", "event_id")
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, at))
    per = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.coalesce(F.bool_and(F.col("event_type").isin(*EVENT_TYPES)), F.lit(True)).alias("known"),
        F.min_by("event_type", at).alias("first_type"),
        F.max_by("event_type", at).alias("last_type"),
        last("purchase").alias("_p"),
        last("error").alias("_e"),
    )
    failed = F.col("_e").isNotNull() & (F.col("_p").isNull() | (F.col("_e") > F.col("_p")))
    state = F.when(failed, "failed").when(F.col("_p").isNotNull(), "bought").otherwise("open")
    return per.select("user_id", "day", "n_events", "known", "first_type", "last_type", state.alias("state"))


def hold_back(spark: SparkSession, sf: str) -> DataFrame:
    """The stored pieces of each text as they would be shown one by one, with the sentinel's prefixes held back."""
    c = table(spark, sf, "chunks").where("text is not null").select(F.concat_ws("|", "doc_id", "strategy").alias("query_id"), F.struct("pos", "chunk_id").alias("seq"), F.col("text").alias("piece"))
    return events.released(c).select("query_id", F.col("seq.chunk_id").alias("chunk_id"), F.md5("text").alias("text_md5"))


def timings_total(spark: SparkSession, sf: str) -> DataFrame:
    """The total of each request as the sum of its timings, and whether the logged total agrees."""
    r = table(spark, sf, "responses").where("timings_ms is not null")
    total = F.round(F.aggregate(F.map_values("timings_ms"), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))), 2)
    return r.select("query_id", total.alias("sum_ms"), (F.abs(total - F.col("total_ms")) < 0.011).alias("agrees"))


def qrels_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The answer key through JSON lines and back under a fixed schema."""
    line = F.to_json(F.struct("q", "rel"))
    back = table(spark, sf, "qrels").select("qrel_id", F.from_json(line, QRELS).alias("r"))
    return back.select("qrel_id", "r.q", F.array_join(F.transform("r.rel", lambda x: F.coalesce(x, F.lit("-"))), ",").alias("rel"))


def wire_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Questions as they travel: prefixed for a search model, as base64 and back, as a line of an event stream and back."""
    q = table(spark, sf, "qrels").where("q is not null")
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("q").alias("content")).alias("delta"))).alias("choices"))))
    media = F.concat(F.lit("audio/"), F.coalesce("lang", F.lit("unk")), F.lit(";codecs=opus"))
    return q.select(
        "qrel_id",
        F.md5(wire.query_text(F.col("q"))).alias("query_md5"),
        F.md5(wire.passage_text(F.col("q"))).alias("passage_md5"),
        F.octet_length(wire.audio_bytes(F.base64(F.encode("q", "UTF-8")))).alias("n_bytes"),
        F.md5(wire.stream_delta(line)).alias("delta_md5"),
        wire.extension(media).alias("ext"),
    )


def retry_waits(spark: SparkSession, sf: str) -> DataFrame:
    """How often each request was logged, and how long a client that backs off would have waited in all."""
    n = table(spark, sf, "requests").where("query_id is not null").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    waits = F.aggregate(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n")), lambda i: F.when(i < F.col("n") - 1, wire.backoff(i)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    return n.select("query_id", "n", waits.alias("waited_s"))


# ---- SQL ---------------------------------------------------------------------------------------
TOK = r"list_transform(regexp_extract_all(coalesce(@, ''), '[0-9A-Za-z\x{0900}-\x{097F}]+'), lambda x: lower(x))"
STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
LABEL = rf"^{S}*([0-9A-Za-z\x{{0900}}-\x{{097F}}]{{1,20}}){S}*[:：]{S}*"
NORMAL = STRIP.replace("@", f"case when list_contains([{', '.join(repr(w) for w in LABELS)}], lower(regexp_extract(m, '{LABEL}', 1))) then regexp_replace(m, '{LABEL}', '') else m end")
SCREEN = f"""
screened as (select distinct query_id, case when coalesce({STRIP.replace('@', 'text')}, '') = '' then 'empty_query'
  when regexp_matches(text, '(?i){HARM}') or regexp_matches(text, '(?i){INJECTION}') then 'unsafe_input' else 'ok' end as screen from requests)
"""
CHECKED = f"""
plain as (select query_id, {NORMAL} as a, passages from (select *, regexp_replace(answer, '[*_`~]+', '', 'g') as m from responses where answer is not null)),
ctx as (select query_id, a, list_distinct(flatten(list_transform(coalesce(passages, []), lambda p: {TOK.replace('@', 'p.text')}))) as c from plain),
toks as (select query_id, c, list_distinct({TOK.replace('@', 'a')}) as t from ctx),
own as (select *, list_filter(t, lambda x: not list_contains({STOP}, x)) as o from toks),
checked as (select query_id, case when len(o) > 0 then len(list_filter(o, lambda x: list_contains(c, x))) / len(o) else 0.0 end as score,
  list_sort(list_filter(t, lambda x: not list_contains(c, x) and (regexp_matches(x, '^[0-9]+$') or (not list_contains({STOP}, x) and length(x) >= 4)))) as bad from own)
"""
TIMES = "times as (select query_id, e.key as stage, e.value as ms from (select query_id, unnest(map_entries(timings_ms)) as e from responses) where e.value is not null)"
STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in evaluation.STAGES) + "]"
SQL = {
    "safety_screen": f"with {SCREEN} select * from screened",
    "screen_counts": f"with {SCREEN} select screen, count(*) as n from screened group by 1",
    "answer_grounding": f"with {CHECKED} select query_id, round(score, 6) as score, array_to_string(bad, ', ') as unsupported, score >= 0.8 and len(bad) = 0 as grounded from checked",
    "grounding_detail": f"with {CHECKED} select query_id, array_to_string(bad[1:5], ', ') as first_five, len(bad) as n_bad from checked where len(bad) > 0",
    "answers_normalized": f"select query_id, {NORMAL} as answer from (select query_id, regexp_replace(answer, '[*_`~]+', '', 'g') as m from responses where answer is not null)",
    "prompt_context": "select query_id, md5(array_to_string(list_transform(passages, lambda p, i: '[' || i || '] ' || coalesce(p.text, '')), chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: ' || query) as prompt_md5 from responses where passages is not null and query is not null",
    "relevance_floor": "select coalesce(top_score, 0) >= 0.8 as relevant, count(*) as n, round(avg(top_score), 6) as mean_top from responses group by 1",
    "refusal_counts": "select coalesce(refusal_reason, 'none') as reason, count(*) as n from responses where refused group by 1",
    "latency_report": f"""with b as (select query_id, total_ms, case when query_id <= (select max(query_id) from (select query_id from responses order by query_id limit 20)) then 'cold' else 'warm' end as bucket from responses), {TIMES},
      every as (select bucket, stage, ms from times join b using (query_id)
        union all select * from (select bucket, 'core', sum(ms) as ms from times join b using (query_id) where stage in ('embed', 'search', 'fetch') group by bucket, query_id) where ms > 0
        union all select bucket, 'total', total_ms from b where total_ms is not null)
      select bucket, stage, count(*) as n, round(quantile_cont(ms, 0.5), 4) as p50, round(quantile_cont(ms, 0.7), 4) as p70, round(max(ms), 4) as p100 from every group by 1, 2""",
    "latency_floor_rank": "with v as (select refused, list(total_ms order by total_ms) as v from responses where total_ms is not null group by 1) select refused, len(v) as n, v[least(len(v), cast(floor(0.5 * len(v)) as int) + 1)] as p50, v[least(len(v), cast(floor(0.7 * len(v)) as int) + 1)] as p70, v[len(v)] as p100 from v",
    "stage_waterfall": f"with {TIMES}, o as (select *, list_position({STAGE_LIST}, stage) as k from times where list_contains({STAGE_LIST}, stage)) select query_id, stage, ms, round(coalesce(sum(ms) over (partition by query_id order by k rows between unbounded preceding and 1 preceding), 0), 4) as start_ms from o",
    "budget_flags": f"with {TIMES}, s as (select query_id, round(sum(case when stage in ('safety', 'embed', 'search', 'fetch', 'relevance', 'grounding') then ms else 0 end), 4) as own_ms, round(sum(case when stage in ('safety', 'embed', 'search', 'fetch', 'relevance', 'grounding') then 0 else ms end), 4) as remote_ms from times group by 1) select *, own_ms <= 200 as in_budget from s",
    "rolling_history": "with w as (select user_id, event_id, list_sort(list(value) over (partition by user_id order by ts, event_id rows between 99 preceding and current row)) as v from events where value is not null) select user_id, event_id, len(v) as n, v[least(len(v), cast(floor(0.5 * len(v)) as int) + 1)] as p50, v[least(len(v), cast(floor(0.7 * len(v)) as int) + 1)] as p70, v[len(v)] as p100 from w",
    "event_percentiles": "select event_type, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.7), 6) as p70, round(max(value), 6) as p100 from events where value is not null group by 1",
    "score_separation": "with h as (select distinct hit_id, query_id, cast(round(score * 1000000) as bigint) as m, rank from search_hits where query_id is not null and score is not null), a as (select query_id, arg_max(m, (-rank, m)) as top, cast(sum(m) as bigint) as s, count(*) as n from h group by 1) select query_id, top / 1e6::double as top1, case when n > 1 then (top * (n - 1) - (s - top))::double / ((n - 1) * 1000000)::double end as margin from a",
    "hit_recall": f"""with asked as (select distinct r.query_id, q.rel from requests r join qrels q on q.q = {STRIP.replace('@', 'r.text')}),
      rel as (select distinct query_id, doc_id from (select query_id, unnest(rel) as doc_id from asked) where doc_id is not null),
      f as (select h.query_id, min(rank) + 1 as first from search_hits h join rel r on r.query_id = h.query_id and r.doc_id = h.doc_id where rank < 20 group by 1)
      select count(*) as n_queries, {', '.join(f'round(avg(case when first <= {k} then 1.0 else 0.0 end), 6) as recall_at_{k}' for k in evaluation.CUTS)}, round(avg(coalesce(1.0 / first, 0.0)), 6) as mrr
      from (select distinct query_id from asked) left join f using (query_id)""",
}
HELD = f"""
pieces as (select concat_ws('|', doc_id, strategy) as query_id, chunk_id, text as piece, row_number() over (partition by doc_id, strategy order by pos, chunk_id) as seq from chunks where text is not null),
grown as (select *, string_agg(piece, '' order by seq) over (partition by query_id order by seq) as so_far from pieces),
flagged as (select *, starts_with('{events.SENTINEL}', trim(so_far)) as held from grown),
shown as (select *, coalesce(bool_and(held) over (partition by query_id order by seq rows between unbounded preceding and 1 preceding), true) as before from flagged)
"""
SQL |= {
    "event_rows": "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, event_type from events",
    "event_contract": """with e as (select user_id, strftime(ts, '%Y-%m-%d') as day, event_type as t, {'a': ts, 'b': event_id} as w from events where user_id is not null and ts is not null),
      g as (select user_id, day, count(*) as n_events, coalesce(bool_and(t in ('view', 'click', 'signup', 'purchase', 'error')), true) as known, arg_min(t, w) as first_type, arg_max(t, w) as last_type,
        max(w) filter (t = 'purchase') as p, max(w) filter (t = 'error') as f from e group by 1, 2)
      select user_id, day, n_events, known, first_type, last_type, case when f is not null and (p is null or f > p) then 'failed' when p is not null then 'bought' else 'open' end as state from g""",
    "hold_back": f"with {HELD} select query_id, chunk_id, md5(case when before then so_far else piece end) as text_md5 from shown where not held",
    "timings_total": "select query_id, round(list_sum(list_transform(map_values(timings_ms), lambda x: coalesce(x, 0))), 2) as sum_ms, abs(round(list_sum(list_transform(map_values(timings_ms), lambda x: coalesce(x, 0))), 2) - total_ms) < 0.011 as agrees from responses where timings_ms is not null",
    "qrels_lines": "select qrel_id, q, array_to_string(list_transform(rel, lambda x: coalesce(x, '-')), ',') as rel from qrels",
    "wire_texts": "select qrel_id, md5('query: ' || q) as query_md5, md5('passage: ' || q) as passage_md5, strlen(q) as n_bytes, md5(q) as delta_md5, coalesce(lang, 'unk') as ext from qrels where q is not null",
    "retry_waits": "select query_id, count(*) as n, coalesce(list_sum(list_transform(range(0, count(*) - 1), lambda i: least(4.0, 0.25 * pow(2, i)))), 0)::double as waited_s from requests where query_id is not null group by 1",
}
QUERIES = {
    f: globals()[f]
    for f in "safety_screen screen_counts answer_grounding grounding_detail answers_normalized prompt_context relevance_floor refusal_counts latency_report latency_floor_rank stage_waterfall budget_flags rolling_history event_percentiles score_separation hit_recall event_rows event_contract hold_back timings_total qrels_lines wire_texts retry_waits".split()
}
