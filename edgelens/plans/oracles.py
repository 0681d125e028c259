"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_K = "cast(regexp_extract(props, '[0-9]+') as int)"

#: The log's records, unparsed; ts has the second's resolution that log lines have.
_ACCESS = f"""access as (
  select event_id, t, date_trunc('second', t) as ts, 'site-' || (user_id % 3) as site, '10.0.' || (user_id // 256) || '.' || (user_id % 256) as ip,
    case when event_type in ('purchase', 'signup') then 'POST' else 'GET' end as method,
    case event_type when 'view' then '/api/products/' || event_id when 'click' then '/v1/files/' || md5(cast(event_id as varchar))
      when 'purchase' then '/api/users/' || user_id || '/orders/' || event_id when 'signup' then '/signup'
      else '/download/tok' || (100000000 + event_id) || '/file' end as path,
    'k=' || k || case when k % 2 = 0 then '&u=' || user_id else '' end || case when k % 5 = 0 then '&k=' || (k + 1) else '' end as query,
    cast(case when event_type = 'error' then [500, 404, 400][k % 3 + 1] when event_type = 'signup' then 302 when event_type = 'purchase' then 201
      when event_type = 'click' and t >= timestamp '2024-01-01 00:58:00' then 503 else 200 end as int) as status
  from (select *, {_K} as k, timestamp '2024-01-01' + to_microseconds((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 720) as t from events)
)"""


def _segment(s: str) -> str:
    return f"""case when regexp_full_match({s}, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') then '{{uuid}}'
      when regexp_full_match({s}, '[0-9]+') then '{{id}}' when regexp_full_match({s}, '[0-9a-fA-F]{{16,}}') then '{{hash}}'
      when strlen({s}) >= 12 and regexp_matches({s}, '[0-9]') and regexp_matches({s}, '[a-zA-Z]') and not contains({s}, '-') then '{{token}}' else {s} end"""


def _template(path: str) -> str:
    return f"case when {path} in ('', '/') then '/' else '/' || array_to_string(list_transform(string_split(trim({path}, '/'), '/'), lambda s: {_segment('s')}), '/') end"


_LOG = f"{_ACCESS}, log as (select *, date_trunc('minute', ts) as minute, {_template('path')} as template, case when status // 100 between 1 and 5 then status // 100 else 0 end as k from access)"


def _epoch(column: str) -> str:
    return f"cast(epoch({column}) as bigint)"


_COUNTS = "count(*) as total, " + ", ".join(f"count(*) filter (k = {i}) as c{i}xx" for i in range(1, 6))
_RATES = ", ".join(f"case when count(*) > 0 then count(*) filter (k = {i}) / count(*) else 0.0 end as rate_{i}xx" for i in range(2, 6))
_ZEROS = ", ".join(f"coalesce({c}, 0) as {c}" for c in ["total", *[f"c{i}xx" for i in range(1, 6)]])


def _log(body: str) -> str:
    return f"with {_LOG} {body}"


def _parsed(which: str) -> str:
    return f"with {_ACCESS} select event_id, {_epoch('ts')} as ts, cast(0 as int) as tz_offset_s, site, ip, method, path, query, status, event_id % 5000 as bytes from access where {which}"


def _series(bucket: int, count: int, offset: int) -> str:
    g = 62135596800
    floor = lambda t: f"(({t} + {offset} + {g}) // {bucket} * {bucket} - {g} - {offset})"
    return _log(f""", ends as (select min({_epoch('minute')}) as low, max({_epoch('minute')}) as high from log),
  anchors as (select low, high, {floor('(high + 60)')} + case when {floor('(high + 60)')} <= high then {bucket} else 0 end as anchor from ends),
  shape as (select anchor, {f"{count}" if count > 0 else f"(anchor - {floor('low')}) // {bucket} + 1"} as n from anchors),
  spine as (select anchor - n * {bucket} + i * {bucket} as b from (select anchor, n, unnest(range(n)) as i from shape)),
  sums as (select ({_epoch('minute')} - (anchor - n * {bucket})) // {bucket} * {bucket} + anchor - n * {bucket} as b, {_COUNTS} from log, shape
    where {_epoch('minute')} >= anchor - n * {bucket} and {_epoch('minute')} < anchor group by 1)
  select spine.b as bucket_start, {_ZEROS} from spine left join sums using (b)""")


_DENSE = """both_ as (select '' as scope, * from log union all select site as scope, * from log)"""


def _anomaly(sensitivity: float, tail: str) -> str:
    return _log(f""", {_DENSE}, scopes as (select distinct scope from both_),
  spine as (select scope, unnest(generate_series((select min(minute) from log), (select max(minute) from log), interval 1 minute)) as minute from scopes),
  dense as (select scope, minute, {_ZEROS} from spine left join (select scope, minute, {_COUNTS} from both_ group by all) using (scope, minute)),
  each_ as (select scope, minute, {_epoch('minute')} as s, total, '5xx' as label, c5xx as hit from dense union all select scope, minute, {_epoch('minute')}, total, '4xx', c4xx from dense),
  r as (select *, case when total >= 5 then hit / total end as r from each_),
  w as (select scope, label, s as minute, count(r) over b as baseline_minutes, avg(r) over b as mean, stddev_pop(r) over b as stddev,
      sum(hit) over e as hit, cast(sum(total) over e as bigint) as samples from r
    window b as (partition by scope, label order by s range between 3660 preceding and 120 preceding), e as (partition by scope, label order by s range between 60 preceding and current row)),
  f as (select scope, label, minute, baseline_minutes, mean, stddev, case when samples > 0 then hit / samples else 0.0 end as rate, samples, mean + {sensitivity} * stddev as upper from w),
  g as (select *, coalesce(baseline_minutes >= 5 and samples >= 20 and rate >= 0.02 and rate > upper, false) as fires from f)
  select scope, label, minute, baseline_minutes, round(mean, 6) as mean, round(stddev, 6) as stddev, round(rate, 6) as rate, samples, round(upper, 6) as upper, fires from g {tail}""")


_PAIRS = r"""unnest(list_distinct(list_transform(list_filter(string_split({q}, '&'), lambda p: p <> '' and not contains(p, ';')), lambda p: url_decode(replace(string_split(p, '=')[1], '+', ' ')))))"""
_REQ = """req as (select conv_id, turn, '/search' as path, concat_ws('&', case turn % 5 when 1 then 'id=1+union+all+select+name' when 2 then 'q=%3Cscript%3Ealert(1)' when 3 then 'f=..%2F..%2Fetc%2Fpasswd' else '' end, text) as query,
  case when conv_id % 7 = 0 then 'sqlmap/1.8' else 'Mozilla/5.0' end as ua from conversations),
canon as (select conv_id, turn, path as p, lower(case when regexp_matches(query, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') then query else url_decode(replace(query, '+', ' ')) end) as q, lower(ua) as ua from req),
cu as (select *, p || case when q = '' then '' else '?' || q end as u, concat_ws(chr(10), p, q, ua, '', '', '') as a from canon)"""


def _rule(targets: list[str], words: list[str], regex: str = "") -> str:
    has = lambda t: "(" + " or ".join(f"contains({t}, '{w}')" for w in words) + ")"
    hit = lambda t: f"regexp_matches({t}, '{regex}')" if regex else has(t)
    return f"({has('a')} and ({' or '.join(f'({t} <> $$$$ and {hit(t)})' for t in targets)}))"


# The shipped rules, written out here too, so that a wrong one in the code shows: id, severity, whether it
# blocks, targets, keywords, pattern.
_SIGNATURES = [
    ("SQLI-001", 10, False, "q u", ["union", "select"], r"union[\s\S]{0,40}select"),
    ("SQLI-002", 6, False, "q u", ["or ", "and "], r"""(or|and)\s+['"]?\w+['"]?\s*=\s*['"]?\w+"""),
    ("SQLI-003", 8, False, "q u", ["sleep(", "benchmark(", "waitfor delay", "information_schema", "load_file(", "pg_sleep("], ""),
    ("XSS-001", 6, False, "q u", ["<script", "javascript:", "onerror=", "onload=", "onmouseover="], r"<script|javascript:|on(error|load|mouseover|focus)\s*="),
    ("XSS-002", 5, False, "q u", ["<img", "<svg", "<iframe", "<body"], r"<(img|svg|iframe|body)[^>]{0,60}on\w+\s*="),
    ("TRAV-001", 6, False, "p q u", ["../", "..\\"], r"\.\./|\.\.\\"),
    ("FILE-001", 8, False, "p u q", ["/etc/passwd", "/etc/shadow", "wp-config.php", "/.env", "/.git/", "web.config", "id_rsa"], ""),
    ("CMDI-001", 8, False, "q u", ["/bin/bash", "/bin/sh", ";cat ", "|nc ", "$(", "&&curl", "&&wget", "wget http", "curl http"], ""),
    ("RFI-001", 8, False, "q u", ["php://", "data://", "file://", "expect://", "phar://"], ""),
    ("LOG4J-001", 10, True, "a", ["${jndi:", "jndi:ldap", "jndi:rmi", "jndi:dns"], ""),
    ("SCAN-001", 10, True, "ua", ["sqlmap", "nikto", "nessus", "masscan", "nmap", "dirbuster", "gobuster", "wpscan", "acunetix", "fimap", "havij", "arachni", "zgrab"], ""),
]


def _verdict(select: str) -> str:
    parts = []
    for name, severity, block, targets, words, regex in _SIGNATURES:
        test = _rule(targets.split(), words, regex.replace("'", "''"))
        parts.append(f"case when {test} then {{'id': '{name}', 's': {severity}, 'b': {str(block).lower()}}} end")
    found = f"list_filter([{', '.join(parts)}], lambda m: m is not null)"
    return f"""with recursive {_REQ}, m as (select conv_id, turn, {found} as ms from cu),
v as (select conv_id, turn, array_to_string(list_transform(ms, lambda m: m.id), ',') as matches, cast(coalesce(list_sum(list_transform(ms, lambda m: m.s)), 0) as int) as score, len(list_filter(ms, lambda m: m.b)) > 0 as flagged from m)
{select}"""


def _cooled(rows: str, keys: str, seconds: int) -> str:
    """CTEs sent_i and sent: the rows (keys, s) of ``rows`` that a cooldown lets through, by recursion over each key's times."""
    same = " and ".join(f"w.{k} = r.{k}" for k in keys.split(", "))
    wk = ", ".join(f"w.{k}" for k in keys.split(", "))
    return f"""times as (select {keys}, s, row_number() over (partition by {keys} order by s) as i from (select distinct {keys}, s from {rows})),
  folds as (select {keys}, i, s, s as last, true as sent from times where i = 1
    union all select {wk}, w.i, w.s, case when w.s - r.last >= {seconds} then w.s else r.last end, w.s - r.last >= {seconds} from folds r join times w on {same} and w.i = r.i + 1),
  sent as (select {keys}, s from folds where sent)"""


def _arrivals(body: str) -> str:
    """CTE a: each ip's requests in order, i from 1, t in seconds; then the recursion over them."""
    return f"""with recursive {_ACCESS}, a as (select event_id, ip, status, epoch_us(t) / 1e6 as s, row_number() over (partition by ip order by t, event_id) as i from access), {body}"""


_BUCKET = "least(3.0::double, r.tokens + (a.s - r.last) * 0.01::double)"
_RATE_LIMIT = _arrivals(f"""r as (select ip, i, event_id, s as last, 2.0::double as tokens, true as allowed from a where i = 1
  union all select a.ip, a.i, a.event_id, a.s, {_BUCKET} - case when {_BUCKET} >= 1 then 1.0::double else 0.0::double end, {_BUCKET} >= 1 from r join a on a.ip = r.ip and a.i = r.i + 1)
select event_id, ip, allowed from r""")
_DECISION = _arrivals(f"""first as (select ip, i, event_id, s as last, 2.0::double as tokens, case when status = 500 then s + 600.0::double else -1e18::double end as until, case when status = 500 then 'blocked' else 'allowed' end as decision from a where i = 1),
r as (select * from first
  union all select ip, i, event_id, case when banned then last else s end, case when banned then tokens when have < 1 then have else have - 1.0::double end,
    case when not banned and (have < 1 or status = 500) then greatest(until, s + 600.0::double) else until end,
    case when banned then 'banned' when have < 1 then 'limited' when status = 500 then 'blocked' else 'allowed' end
  from (select a.ip, a.i, a.event_id, a.s, a.status, r.last, r.tokens, r.until, a.s < r.until as banned, {_BUCKET} as have from r join a on a.ip = r.ip and a.i = r.i + 1))
select event_id, ip, decision from r""")

_FAILED = "failed as (select * from log where status >= 400)"

SQL: dict[str, str] = {
    "parse_combined": _parsed("event_id % 2 = 0"),
    "parse_json": _parsed("event_id % 2 = 1"),
    "parse_mixed": _parsed("true"),
    "normalize_paths": _log("select event_id, path, template from log"),
    "normalize_patterns": f"""with {_ACCESS} select event_id, case when regexp_full_match(path, '/api/users/[^/]*/orders/[^/]*') then '/api/users/{{user}}/orders/{{order}}'
      when regexp_full_match(path, '/api/products/[^/]*') then '/api/products/{{sku}}' else {_template('path')} end as template from access""",
    "ignore_since": f"with {_ACCESS} select event_id, {_epoch('ts')} as ts, path from access where path <> '/signup' and not starts_with(path, '/api/users/') and ts >= timestamp '2024-01-01 00:30:00'",
    "overview": _log(f"select {_COUNTS}, count(distinct ip) as distinct_ips, count(distinct (site, method, template)) as distinct_endpoints, string_agg(distinct site, ',' order by site) as sites, {_RATES} from log"),
    "site_totals": _log(f"select site, {_COUNTS}, {_RATES} from log group by site"),
    "minute_series": _log(f"select {_epoch('minute')} as minute, {_COUNTS} from log where minute >= timestamp '2024-01-01 00:10:00' group by 1"),
    "minute_codes": _log(f"select {_epoch('minute')} as minute, status, count(*) as n from log group by 1, 2"),
    "site_minute_dense": _log(f""", {_DENSE}, spine as (select scope, unnest(generate_series(timestamp '2023-12-31 23:55:00', timestamp '2024-01-01 01:04:00', interval 1 minute)) as minute from (select distinct scope from both_))
      select scope, {_epoch('minute')} as minute, {_ZEROS} from spine left join (select scope, minute, {_COUNTS} from both_ group by all) using (scope, minute)"""),
    "series_4m": _series(240, 15, 0),
    "series_1h": _series(3600, 12, 0),
    "series_week": _series(604800, 0, 18000),
    "top_ips": _log(f"select ip, {_COUNTS}, {_epoch('min(ts)')} as first_ts, {_epoch('max(ts)')} as last_ts, string_agg(distinct site, ',' order by site) as sites, count(distinct template) as templates, {_RATES} from log group by ip order by total desc, ip limit 50"),
    "ip_detail": _log("select ip, template, count(*) as hits from log where ip = '10.0.0.7' group by all"),
    "ip_templates_capped": _log(f"select ip, template, count(*) as hits, {_epoch('min(ts)')} as first_ts from log group by ip, template qualify row_number() over (partition by ip order by min(ts), template) <= 3"),
    "top_endpoints": _log(f"select site, method, template, {_COUNTS}, count(distinct ip) as distinct_ips, {_epoch('max(ts)')} as last_ts, {_RATES} from log group by site, method, template order by total desc, site, method, template limit 50"),
    "failing_events_capped": _log(f""", {_FAILED}, n as (select count(*) as n from failed)
      select {_epoch('ts')} as ts, site, ip, method, path, query, status from failed, n
      qualify row_number() over (order by ts, site, ip, method, path, query, status) > case when n.n <= 100 then 0 else (n.n - 100 + 9) // 10 * 10 end"""),
    "report_endpoints": _log(f", {_FAILED} select site, method, template, count(*) as n, count(*) filter (status between 400 and 499) as c4xx, count(*) filter (status between 500 and 599) as c5xx from failed group by all"),
    "report_keys": _log(f", {_FAILED} select key, count(*) as n, count(*) / (select count(*) from failed) as coverage from (select {_PAIRS.format(q='query')} as key from failed) group by key"),
    "report_rows": _log(f""", {_FAILED} select strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as date, ip, status, method, template as endpoint,
      array_to_string(list_transform(list_filter(string_split(query, '&'), lambda p: starts_with(p, 'k=')), lambda p: p[3:]), ' | ') as k,
      array_to_string(list_transform(list_filter(string_split(query, '&'), lambda p: starts_with(p, 'u=')), lambda p: p[3:]), ' | ') as u
      from failed where status between 500 and 599 and ts >= timestamp '2024-01-01 00:10:00' and ts < timestamp '2024-01-01 00:59:00'
      order by ts desc, site, ip, method, path, query, status limit 200"""),
    "report_raw_fallback": """select page_id, 'a%01b' as x, case when y = '' then '' else y end as y, ref from (
      select page_id, regexp_extract(q, '^([^&]*)', 1) as y0, case when contains(q, '=') then '' else q end as z,
        array_to_string(list_transform(list_filter(string_split('y=' || q, '&'), lambda p: string_split(p, '=')[1] = 'y'), lambda p: substr(p, 3)), ' | ') as y,
        array_to_string(list_transform(list_filter(string_split('y=' || q, '&'), lambda p: string_split(p, '=')[1] = 'ref'), lambda p: substr(p, 5)), ' | ') as ref
      from (select page_id, case when contains(u, '?') then substr(u, strpos(u, '?') + 1) else '' end as q from (select page_id, string_split(url, '#')[1] as u from pages)))""",
    "window_status_count": _log(", e as (select max(minute) as now from log) select cast(coalesce(sum(case k when 5 then 1 when 4 then 2 else 0 end), 0) as bigint) as matched, count(*) as total from log, e where minute > now - interval 5 minute and minute <= now"),
    "window_ip_counts": _log(", e as (select max(minute) as now from log) select ip, count(*) as n from log, e where minute > now - interval 10 minute and minute <= now group by ip"),
    "alert_status_count": _log(""", e as (select max(minute) as now from log), c as (select count(*) filter (k = 5) as m from log, e where minute > now - interval 2 minute and minute <= now)
      select 'many-5xx' as id, 'threshold' as kind, '' as site, 'status_count' as metric, cast(m as double) as value, 10.0::double as threshold, 'many-5xx: ' || m || ' matching requests in 120s (threshold 10)' as message from c where m >= 10"""),
    "alert_ip_flood": _log(""", e as (select max(minute) as now from log), c as (select ip, count(*) as n from log, e where minute > now - interval 60 minute and minute <= now group by ip order by n desc, ip limit 1)
      select 'flood' as id, 'threshold' as kind, ip, 'ip_request_count' as metric, cast(n as double) as value, 5.0::double as threshold, 'flood: IP ' || ip || ' made ' || n || ' requests in 3600s (threshold 5)' as message from c where n >= 5"""),
    "anomaly_latest": _anomaly(3.0, "where minute = (select max(minute) from g)"),
    "anomaly_backtest": _anomaly(3.0, ""),
    "alert_cooldown": _anomaly(0.5, "where false").replace("with access", "with recursive access", 1).replace("select scope, label, minute, baseline_minutes, round", f""", fired as (select *, minute as s from g where fires), {_cooled("fired", "scope, label", 300)}
  select scope, label, minute, baseline_minutes, round""").replace("from g where false", "from fired semi join sent using (scope, label, s)"),
    "rate_limit": _RATE_LIMIT,
    "inspect_decision": _DECISION,
    "log_line_bans": _verdict(f""", bad as (select '198.51.100.' || (conv_id % 50) as ip, cast(epoch(timestamp '2024-01-01') as bigint) + conv_id * 60 + turn * 10 as s, conv_id * 1000 + turn as line from v where score >= 15), {_cooled("bad", "ip", 900)}
      select ip, s as ts, min(line) as line, 'observer' as reason, s + 900 as expires from bad semi join sent using (ip, s) group by ip, s"""),
    "client_address": f"""with {_ACCESS} select event_id, case when event_id % 4 = 0 then ip when event_id % 4 = 1 then '203.0.113.' || (event_id % 200)
      when event_id % 3 = 1 then '2001:db8::' || status else ip end as client from access""",
    "since_argument": f"""with {_ACCESS}, s as (select event_id, cast(epoch(date_trunc('second', t)) as bigint) as s, cast(epoch(date_trunc('day', t)) as bigint) as d from access)
      select event_id, case event_id % 10 when 0 then s - 7200 when 1 then s + 12600 when 4 then d when 8 then d when 9 then null else s end as since from s""",
    "report_total": _log(f", {_FAILED} select count(*) as total from failed where status between 500 and 599 and ts >= timestamp '2024-01-01 00:10:00' and ts < timestamp '2024-01-01 00:59:00'"),
    "evict_retention": _log(f"select site, {_COUNTS}, {_RATES} from log where minute >= timestamp '2024-01-01 00:30:00' group by site"),
    "evict_lru_ips": _log(f"select ip, count(*) as total, {_epoch('max(ts)')} as last_ts from log group by ip order by max(ts) desc, ip limit 100"),
    "request_normalize": f"with {_REQ} select conv_id, turn, md5(a) as any_md5, md5(u) as uri_md5 from cu",
    "keyword_match": """select doc_id, array_to_string(list_filter(['password', 'token', 'the', 'he', 'rights reserved'], lambda w: contains(lower(text), w)), ',') as found,
      coalesce(contains(lower(text), 'password') or contains(lower(text), 'token'), false) as any_found from documents""",
    "signature_verdict": _verdict("select conv_id, turn, matches, score, flagged or score >= 10 as block from v"),
    "signature_score": _verdict("select score, flagged or score >= 10 as block, count(*) as n from v group by all"),
    "active_bans": f"""with {_ACCESS}, b as (select ip, max(epoch_us(t) // 1000000 + 900) as expires, arg_min(cast(status as varchar), (-(epoch_us(t) // 1000000 + 900), cast(status as varchar))) as reason from access where status >= 500 group by ip)
      select ip, reason, expires from b where expires > epoch(timestamp '2024-01-01 01:00:00')""",
    "page_url_templates": f"select {_template('path')} as template, count(*) as n from (select string_split(string_split(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#')[1], '?')[1] as path from pages) group by 1",
    "page_query_keys": f"with r as (select case when contains(u, '?') then substr(u, strpos(u, '?') + 1) else '' end as q from (select string_split(url, '#')[1] as u from pages)) select key, count(*) as n, count(*) / (select count(*) from r) as coverage from (select {_PAIRS.format(q='q')} as key from r) group by key",
}

SQL |= {
    "request_parameters": f"""with {_ACCESS} select event_id, case event_id % 6 when 0 then event_id when 1 then 7 when 4 then -3 else 50 end as limit_,
      [90.0::double, 5400, 60, 60, 90.25, 60, 60][event_id % 7 + 1] as window_s, case event_id % 3 when 0 then event_id end as start,
      ['4|5', event_id || '|-1', '', ''][event_id % 4 + 1] as classes, ['4|5|x', event_id || '|-1|2.5', '', 'a|b'][event_id % 4 + 1] as items from access""",
    "templates_by_version": f"""with {_ACCESS}, v as (select *, cast(case when t >= timestamp '2024-01-01 00:40:00' then 3 when t >= timestamp '2024-01-01 00:20:00' then 2 else 1 end as bigint) as version from access)
      select event_id, case when version = 2 and path like '/api/users/%' then '/api/users/{{user}}/orders/{{order}}' when version = 2 and path like '/api/products/%' then '/api/products/{{sku}}'
        when version = 3 and path like '/download/%' then '/download/{{token}}/file' else {_template('path')} end as template, version from v where not (version = 3 and path = '/signup')""",
    "ban_changes": f"""with {_ACCESS}, b as (select ip, epoch_us(t) as s, epoch_us(t) + 120000000 as e, cast(status as varchar) as reason from access where status >= 500),
      o as (select *, coalesce(s > max(e) over (partition by ip order by s, reason rows between unbounded preceding and 1 preceding), true) as opens from b),
      n as (select *, sum(opens::int) over (partition by ip order by s, reason rows unbounded preceding) as n from o),
      i as (select ip, min(s) as s, max(e) as e, arg_min(reason, (s, reason)) as reason from n group by ip, n)
      select ip, s as us, 'ban' as action, reason from i union all select ip, e, 'unban', reason from i""",
    "blocked_asof": f"""with {_ACCESS} select event_id, ip, exists (select 1 from access b where b.status >= 500 and b.ip = a.ip and b.t < a.t and epoch_us(a.t) < epoch_us(b.t) + 120000000) as blocked from access a""",
    "trap_port_bans": f"""with recursive {_ACCESS}, bad as (select ip, cast(epoch(ts) as bigint) as s, event_id % 3 + 2222 as port from access where status = 400), {_cooled("bad", "ip", 300)}
      select ip, s as ts, 'sentinel: trap port ' || min(port) as reason, s + 300 as expires from bad semi join sent using (ip, s) group by ip, s""",
    "keyword_match_many": """with s as (select ['the', 'an', 're', 'in', 'on', 'er', 'nd', 'st', 'es', 'ti', 'ha', 'wh', 'ou', 'ed', 'ea', 'or', 'at', 'ing', 'tion', 'ly', 'ble', 'sh', 'en', 'éré', 'ci', 'ung'] as s),
      k as (select flatten(list_transform(s, lambda a: list_transform(s, lambda b: a || b))) as k from s),
      f as (select doc_id, list_filter((select k from k), lambda w: contains(lower(text), w)) as f from documents)
      select doc_id, cast(coalesce(len(f), 0) as int) as n, md5(coalesce(array_to_string(f, ','), '')) as found_md5 from f""",
    "guard_health": f"""select 'ok' as status, 'enforce' as mode, 11 as rules, cast(epoch(timestamp '2024-01-01 01:00:00') as bigint) as time, d.*, b.* from
      (select count(*) as total, count(*) filter (decision in ('banned', 'limited', 'blocked')) as denied, count(*) filter (decision = 'flagged') as flagged from ({_DECISION})) d,
      (with {_ACCESS} select count(*) as active_bans from (select max(epoch_us(t) // 1000000 + 900) as expires from access where status >= 500 group by ip) where expires > epoch(timestamp '2024-01-01 01:00:00')) b""",
}
