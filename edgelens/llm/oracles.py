"""DuckDB SQL for the queries that SQL can express."""

_RULES = "(values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))"

_OP8 = f"""
with rest as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as r from pages
), split as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest
), fits as (
  select s.*, v.verdict, v.host || v.path as rule from split s left join {_RULES} as v(verdict, host, path)
    on (s.host = v.host or ends_with(s.host, '.' || v.host)) and starts_with(s.path, v.path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits
qualify row_number() over (partition by page_id order by length(rule) desc nulls last) = 1
"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: str, order: int, pattern: str, least: int, group: int) -> str:
    cut = f"(?s)(.*?)({pattern})|.+"
    kept = f"regexp_extract_all(text, '{cut}', {2 + group})" if group else f"regexp_extract_all(text, '{cut}', 2)"
    return f"""
select doc_id, '{kind}' as kind, {order} as ord, s - length(m) as s, s as e, k from (
  select doc_id, m, k, sum(length(g) + length(m)) over (partition by doc_id order by i) as s from (
    select doc_id, unnest(regexp_extract_all(text, '{cut}', 1)) as g, unnest(regexp_extract_all(text, '{cut}', 2)) as m,
           unnest({kept}) as k, unnest(range(len(regexp_extract_all(text, '{cut}', 1)))) as i
    from documents where regexp_matches(text, '{pattern}'))
  ) where length(k) >= {least} and m <> ''"""


_OP3 = f"""
with found as ({_matches("assign", 0, _ASSIGN, 6, 1)} union all {_matches("access", 1, "AKIA[A-Z0-9]+", 20, 0)} union all {_matches("hex", 2, "[0-9a-f]+", 24, 0)}
), joined as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
         string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, ord) as spans
  from found group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join joined j using (doc_id)
"""

_OP9 = """
with v as (
  select vec_id, [cast(floor(1024 * cast(c as double)) as bigint) for c in embedding] as x from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len([c for c in embedding if c is null or not isfinite(c)]) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.x) = len(c.x)
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from scored qualify rank <= 10
"""

_OP11 = r"""
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents
), words as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from texts
), marks as (select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic from labels group by doc_id
), failed as (
  select part, coalesce(m.good, false) as good, coalesce(m.toxic, false) as toxic, {
      'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) over (partition by text), false)} as f
  from words d left join marks m on d.doc_id = m.doc_id
), perms as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from (values ('A'), ('B'), ('C'), ('D'), ('E')) a(x), (values ('A'), ('B'), ('C'), ('D'), ('E')) b(x),
    (values ('A'), ('B'), ('C'), ('D'), ('E')) c(x), (values ('A'), ('B'), ('C'), ('D'), ('E')) d(x), (values ('A'), ('B'), ('C'), ('D'), ('E')) e(x)
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), masks as (
  select part, f, list_filter([case when f.A then 'A' end, case when f.B then 'B' end, case when f.C then 'C' end, case when f.D then 'D' end, case when f.E then 'E' end], lambda k: k is not null) as bad, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from failed group by part, f
), steps as (select filter_order, step, filter_order[step] as letter from perms, (select unnest(range(1, 6)) as step) s
), rows_ as (
  select part, filter_order, step, letter, cast(sum(n) filter (len(list_filter(bad, lambda k: strpos(filter_order[1:step], k) > 0)) = 0) as bigint) as kept,
    cast(sum(n) filter (list_contains(bad, letter) and len(list_filter(bad, lambda k: strpos(filter_order[1:step - 1], k) > 0)) = 0) as bigint) as removed,
    cast(sum(n) filter (list_contains(bad, letter) and len(list_filter(bad, lambda k: strpos(filter_order[1:step - 1], k) > 0)) > 0) as bigint) as redundant,
    cast(sum(n) filter (bad = [letter]) as bigint) as unique_fails,
    cast(sum(good) filter (list_contains(bad, letter) and len(list_filter(bad, lambda k: strpos(filter_order[1:step - 1], k) > 0)) = 0) as bigint) as good_lost,
    cast(sum(toxic) filter (list_contains(bad, letter) and len(list_filter(bad, lambda k: strpos(filter_order[1:step - 1], k) > 0)) = 0) as bigint) as toxic_lost
  from masks, steps group by part, filter_order, step, letter
)
select part, filter_order, cast(step as int) as step, coalesce(kept, 0) as kept, coalesce(removed, 0) as removed, coalesce(redundant, 0) as redundant, coalesce(unique_fails, 0) as unique_fails,
  coalesce(good_lost, 0) as good_lost, coalesce(toxic_lost, 0) as toxic_lost, cast(sum(coalesce(removed, 0)) over (partition by part, letter) as bigint) as shapley
from rows_
"""

# Steps backward over each conversation's rows; a state's best way is a struct, so that lists of them have a least one.
_CRC = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({s}, ''), lambda c: ascii(c)::bigint)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""


def _way(cost: str, edit: str, to: str) -> str:
    return f"{{'c': {cost} + {to}.c, 'a': '{edit}' || {to}.a}}"


def _after_row(state: int) -> str:
    """The best way on from a state, the next row's symbol being y: K, R or D."""
    x = "case when y between 'A' and 'Z' then 3 else 0 end"
    turns = {0: [("u", "w2"), ("s", "w1")], 1: [("u", "w2")], 2: [("a", "w3")], 3: [("u", "w2")]}[state]
    keeps = [f"case when lower(y) = '{role}' then {_way(x, 'K', to)} end" for role, to in turns]
    rerole = f"case when y <> 'x' then {_way('3 + ' + x, 'R', turns[0][1])} end"
    return f"list_aggregate([{', '.join([*keeps, rerole, _way('4', 'D', f'w{state}')])}], 'min')"


def _with_inserts(state: int) -> str:
    others = {0: [("3", "I", "r2"), ("6", "II", "r3")], 1: [("3", "I", "r2"), ("6", "II", "r3")], 2: [("3", "I", "r3")], 3: [("3", "I", "r2")]}[state]
    return f"list_aggregate([r{state}, {', '.join(_way(*o) for o in others)}], 'min') as w{state}"


_OP12 = rf"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC.format(s="coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as k from conversations
), rows_ as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from k, (select unnest([0, 1]) as copy) c where k <> 0 and (copy = 0 or k = 3)
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || text)) as i from rows_
), faults as (
  select *, substr(role, 1, 1) as initial, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault from placed
), symbols as (
  select *, case when fault in ('blank', 'duplicate') then 'x' when fault = 'truncated' then upper(case when initial in ('s', 'u', 'a') then initial else 'o' end)
    when initial in ('s', 'u', 'a') then initial else 'o' end as y, initial || lead(initial) over (partition by conv_id order by i) as pair from faults
), counted as (
  select conv_id, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, list(y order by i) as seq, count(*) as n
  from symbols group by conv_id
), ways as (
  select conv_id, seq, n as i, {{'c': 0, 'a': ''}} as w0, {{'c': 6, 'a': 'II'}} as w1, {{'c': 3, 'a': 'I'}} as w2, {{'c': 0, 'a': ''}} as w3 from counted
  union all
  select conv_id, seq, i - 1, {", ".join(_with_inserts(s) for s in range(4))} from (
    select conv_id, seq, i, {", ".join(f"{_after_row(s)} as r{s}" for s in range(4))} from (select *, seq[i] as y from ways where i > 0))
), solved as (select conv_id, cast(w0.c as bigint) as cost, w0.a as audit from ways where i = 0
), edits as (
  select conv_id, p, audit[p] as e, length(replace(audit[1:p], 'I', '')) as i, length(replace(audit[1:p], 'D', '')) as place from solved, unnest(range(1, length(audit) + 1)) as u(p)
), led as (
  select e.*, s.role, s.text, max(case when place = 1 and e = 'K' and initial = 's' then 1 else 0 end) over (partition by e.conv_id) as led
  from edits e left join symbols s on e.conv_id is not distinct from s.conv_id and e.e <> 'I' and s.i = e.i
), texts as (
  select conv_id, string_agg(case when e = 'K' then role || ':' || text else case when (place - led) % 2 = 1 then 'user:' else 'assistant:' end || case when e = 'I' then '' else text end end, chr(10) order by p) as t
  from led where e <> 'D' group by conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counted c on o.conv_id is not distinct from c.conv_id left join solved s on o.conv_id is not distinct from s.conv_id
  left join texts t on o.conv_id is not distinct from t.conv_id
"""

ORACLE_SQL: dict[str, str] = {"op3_secrets": _OP3, "op8_url_filter": _OP8, "op9_topk": _OP9, "op11_filter_audit": _OP11, "op12_conversation_repair": _OP12}
