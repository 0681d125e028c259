"""Schemas of the log records and of what is derived from them."""

#: One parsed request.
RECORD = "ts timestamp, tz_offset_s int, site string, ip string, method string, path string, query string, status int, bytes long, referer string, ua string"
RECORD_NAMES = [f.split()[0] for f in RECORD.split(", ")]

#: The fields of a JSON log line; others are ignored.
JSON_LINE = "v int, time string, remote_addr string, forwarded_for string, method string, uri string, status int, bytes_sent long, referer string, user_agent string"

#: Additive partial aggregate from which the views are answered.
HITS = "minute timestamp, site string, method string, template string, ip string, status int, n long, first_ts timestamp, last_ts timestamp"

#: Requests that failed, one by one.
FAILURES = "ts timestamp, tz_offset_s int, site string, ip string, method string, path string, template string, query string, status int"
