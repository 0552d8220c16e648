"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from . import fim, replies, resample, urls

SECRETS = r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as owner, coalesce(lang, '') as lang from documents),
found as (
  select doc_id, owner, lang, 0 as k, regexp_split_to_array(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as parts,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as hits,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) as vals, 6 as least from d
  union all select doc_id, owner, lang, 1, regexp_split_to_array(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), 20 from d
  union all select doc_id, owner, lang, 2, regexp_split_to_array(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), 24 from d
  union all select doc_id, owner, lang, 3, regexp_split_to_array(t, '[A-Za-z0-9+/_-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_-]+'), 20 from d where regexp_matches(t, '[A-Za-z0-9+/_-]{20,}')),
each as (select doc_id, owner, lang, k, hits, parts, vals, least, unnest(range(1, len(hits) + 1)) as i from found),
sized as (select doc_id, owner, lang, k, i, length(parts[i]) as gap, length(hits[i]) as size, vals[i] as v, least from each),
placed as (select doc_id, owner, lang, k, v, size, least, sum(gap + size) over (partition by doc_id, k order by i rows unbounded preceding) as stop from sized),
spans as (select doc_id, owner, lang, k, v, cast(stop - size as bigint) as start, cast(stop as bigint) as stop from placed
  where length(v) >= least and (k < 3 or (regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]')))),
candidates as (select * from spans s where k < 3 or not exists (select 1 from spans b where b.doc_id = s.doc_id and b.k < 3 and b.start < s.stop and s.start < b.stop)),
frequency as (select *, owners < 3 and not (owners > 1 and repositories >= 6) as live from (select v, count(distinct owner) as owners, count(distinct (owner, lang)) as repositories from candidates group by v)),
judged as (select c.*, live, owners || '/' || repositories as wide, concat(['assign', 'access', 'hex', 'token'][k + 1], ':', start, ':', stop) as said from candidates c join frequency using (v)),
summed as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
  string_agg(said, ',' order by start, k) filter (where k < 3) as base, string_agg(said, ',' order by start, k) filter (where k < 3 or live) as spans, string_agg(wide, ',' order by start, k) filter (where k < 3 or live) as spread,
  count(*) filter (where live) as n_live, count(*) filter (where not live and k < 3) as n_example from judged group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(spread, '') as spread, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example from d left join summed using (doc_id)"""

PHRASES = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
windows as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
firsts as (select k, min(doc_id) as m from windows group by k),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 13)) as p from windows join firsts using (k) where m < doc_id)),
placed as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as word from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from placed anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)"""

NEAR = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
sets as (select distinct doc_id, s from (select doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) = 1 then [ws[1]] else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as s from w)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n_both from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * n_both >= 80 * (x.n + y.n - n_both)),
sides as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from sides union select r.a, s.b from reach r join sides s on r.b = s.a),
lows as (select a as doc_id, min(b) as m from reach group by a)
select w.doc_id, coalesce(n, 0) as n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) as component_id, coalesce(m, w.doc_id) >= w.doc_id as kept from w left join sizes using (doc_id) left join lows using (doc_id)"""

SQL = {"op1_secret_scans": SECRETS, "op3_url_filters": urls.oracle(), "op5_substring_dedup": PHRASES, "op10_near_dedup": NEAR, "op11_chat_formatting": replies.ORACLE, "op12_fill_in_middle": fim.ORACLE, "op13_importance_resampling": resample.ORACLE}
