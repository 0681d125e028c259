"""The registered queries over the access log that the tables give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelens.functions import normalize, parameters, query_string
from edgelens.functions.parse import client_ip, parse_lines, path_of, query_of, since
from edgelens.operators import alerts, enforce, history, report, rollup, series, signatures
from edgelens.plans import config, settings
from edgelens.sources import testlog
from edgelens.sources.tables import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


INGEST = "2024-01-01 02:00:00"
PATTERNS = ["/api/users/:user/orders/:order", "/api/products/:sku"]
FIVES = alerts.AlertRule("many-5xx", classes=(5,), window_s=120, threshold=10)
FLOOD = alerts.AlertRule("flood", metric="ip_request_count", window_s=3600, threshold=5)


def records(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """Parsed from the rendered lines; ``which`` picks lines by event_id."""
    return rollup.templated(parse_lines(testlog.lines(testlog.access(spark, sf_dir)).filter(which), ts(INGEST)))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.hits(records(spark, sf_dir))


def stored_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube as ingest keeps it, for views that take more than one pass."""
    return stored(cube(spark, sf_dir), "hits")


def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.failures(records(spark, sf_dir))


def named(df: DataFrame) -> DataFrame:
    """Times as seconds, so that results compare without zones."""
    times = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.unix_seconds(c) for c in times})


def parsed(rows: DataFrame) -> DataFrame:
    return named(rows.select("event_id", "ts", "tz_offset_s", "site", "ip", "method", "path", "query", "status", "bytes"))


@query
def parse_combined(spark, sf_dir):
    return parsed(records(spark, sf_dir, "event_id % 2 = 0"))


@query
def parse_json(spark, sf_dir):
    return parsed(records(spark, sf_dir, "event_id % 2 = 1"))


@query
def parse_mixed(spark, sf_dir):
    return parsed(records(spark, sf_dir))


@query
def normalize_paths(spark, sf_dir):
    return records(spark, sf_dir).select("event_id", "path", "template")


@query
def normalize_patterns(spark, sf_dir):
    rows = testlog.access(spark, sf_dir)
    return rows.select("event_id", normalize.template(F.col("path"), PATTERNS).alias("template"))


@query
def ignore_since(spark, sf_dir):
    rows = records(spark, sf_dir).filter(~normalize.ignored(F.col("path"), ["/signup/", "/api/users"]) & (F.col("ts") >= ts("2024-01-01 00:30:00")))
    return named(rows.select("event_id", "ts", "path"))


@query
def overview(spark, sf_dir):
    return rollup.overview(stored_cube(spark, sf_dir))


@query
def site_totals(spark, sf_dir):
    return rollup.site_totals(cube(spark, sf_dir))


@query
def minute_series(spark, sf_dir):
    return named(rollup.minute_series(cube(spark, sf_dir), ts("2024-01-01 00:10:00")))


@query
def minute_codes(spark, sf_dir):
    return named(rollup.minute_codes(cube(spark, sf_dir)))


@query
def site_minute_dense(spark, sf_dir):
    c = stored_cube(spark, sf_dir)
    return named(series.dense_minutes(c, ts("2024-01-01 01:04:00"), 70))


@query
def series_4m(spark, sf_dir):
    return named(series.series(stored_cube(spark, sf_dir), 240, 15))


@query
def series_1h(spark, sf_dir):
    return named(series.series(stored_cube(spark, sf_dir), 3600, 12))


@query
def series_week(spark, sf_dir):
    return named(series.series(stored_cube(spark, sf_dir), 604_800, 0, 18_000))


@query
def top_ips(spark, sf_dir):
    return named(rollup.top_ips(cube(spark, sf_dir), 50))


@query
def ip_detail(spark, sf_dir):
    return rollup.ip_detail(cube(spark, sf_dir), "10.0.0.7")


@query
def ip_templates_capped(spark, sf_dir):
    return named(rollup.ip_templates(cube(spark, sf_dir), 3))


@query
def top_endpoints(spark, sf_dir):
    return named(rollup.top_endpoints(cube(spark, sf_dir), 50))


@query
def failing_events_capped(spark, sf_dir):
    return named(rollup.capped_failures(stored(failed(spark, sf_dir), "failures"), 100).select("ts", "site", "ip", "method", "path", "query", "status"))


@query
def report_endpoints(spark, sf_dir):
    return report.endpoints(failed(spark, sf_dir))


@query
def report_keys(spark, sf_dir):
    return report.keys(stored(failed(spark, sf_dir), "failures"))


@query
def report_rows(spark, sf_dir):
    which = report.ReportFilter(classes=(5,), start="2024-01-01 00:10:00", end="2024-01-01 00:59:00")
    return report.rows(failed(spark, sf_dir), ["k", "u"], which, 200)


@query
def report_raw_fallback(spark, sf_dir):
    """Every page url's query with a control character put into one value."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("x=a%01b&y="), query_of(F.split("url", "#")[0])).alias("q"))
    return rows.select("page_id", query_string.shown(F.col("q"), "x").alias("x"), query_string.shown(F.col("q"), "y").alias("y"), query_string.shown(F.col("q"), "ref").alias("ref"))


@query
def window_status_count(spark, sf_dir):
    return alerts.window_status_count(stored_cube(spark, sf_dir), [5, 4, 4], 300)


@query
def window_ip_counts(spark, sf_dir):
    return alerts.window_ip_counts(stored_cube(spark, sf_dir), 600)


@query
def alert_status_count(spark, sf_dir):
    return alerts.status_alert(stored_cube(spark, sf_dir), FIVES)


@query
def alert_ip_flood(spark, sf_dir):
    return alerts.flood_alert(stored_cube(spark, sf_dir), FLOOD)


def _rounded(df: DataFrame) -> DataFrame:
    return named(df.withColumns({c: F.round(c, 6) for c in ("mean", "stddev", "rate", "upper")}))


@query
def anomaly_latest(spark, sf_dir):
    return _rounded(alerts.anomaly_backtest(stored_cube(spark, sf_dir), minutes=1))


@query
def anomaly_backtest(spark, sf_dir):
    return _rounded(alerts.anomaly_backtest(stored_cube(spark, sf_dir)))


@query
def alert_cooldown(spark, sf_dir):
    fired = alerts.anomaly_backtest(stored_cube(spark, sf_dir), alerts.AnomalyConfig(sensitivity=0.5)).filter("fires")
    return _rounded(alerts.cooled(fired, ["scope", "label"], "minute", 300))


@query
def evict_retention(spark, sf_dir):
    return rollup.site_totals(rollup.evict(cube(spark, sf_dir), ts("2024-01-01 01:00:30"), 1800))


@query
def evict_lru_ips(spark, sf_dir):
    return named(rollup.newest_ips(cube(spark, sf_dir), 100))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each turn of a conversation, with its text as the query string, and some texts turned into attacks by turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    attack = F.when(F.col("turn") % 5 == 1, "id=1+union+all+select+name").when(F.col("turn") % 5 == 2, "q=%3Cscript%3Ealert(1)").when(F.col("turn") % 5 == 3, "f=..%2F..%2Fetc%2Fpasswd").otherwise("")
    return rows.select("conv_id", "turn", F.lit("/search").alias("path"), F.concat_ws("&", attack, "text").alias("query"), F.when(F.col("conv_id") % 7 == 0, "sqlmap/1.8").otherwise("Mozilla/5.0").alias("ua"))


@query
def request_normalize(spark, sf_dir):
    return signatures.canonical(requests(spark, sf_dir)).select("conv_id", "turn", F.md5("r_any").alias("any_md5"), F.md5("r_uri").alias("uri_md5"))


@query
def keyword_match(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = ["password", "token", "the", "he", "rights reserved"]
    return rows.select("doc_id", F.array_join(signatures.present(F.lower("text"), words), ",").alias("found"), F.coalesce(signatures.any_present(F.lower("text"), words[:2]), F.lit(False)).alias("any_found"))


@query
def signature_verdict(spark, sf_dir):
    rows = signatures.verdicts(requests(spark, sf_dir))
    return rows.select("conv_id", "turn", F.array_join("matches", ",").alias("matches"), "score", "block")


@query
def signature_score(spark, sf_dir):
    return signatures.verdicts(requests(spark, sf_dir)).groupBy("score", "block").agg(F.count("*").alias("n"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testlog.access(spark, sf_dir).withColumn("ts", F.col("t"))


@query
def rate_limit(spark, sf_dir):
    return enforce.rate_limited(arrivals(spark, sf_dir), 0.01, 3).select("event_id", "ip", "allowed")


@query
def active_bans(spark, sf_dir):
    bad = arrivals(spark, sf_dir).filter("status >= 500").withColumn("reason", F.col("status").cast("string"))
    return named(enforce.active(enforce.bans(bad, 900), ts("2024-01-01 01:00:00")))


@query
def inspect_decision(spark, sf_dir):
    rows = arrivals(spark, sf_dir).withColumn("block", F.col("status") == 500)
    return enforce.decisions(rows, 0.01, 3, 600, True).select("event_id", "ip", "decision")


@query
def page_url_templates(spark, sf_dir):
    path = path_of(F.split(F.regexp_replace("url", "^[a-z]+://[^/?#]*", ""), "#")[0])
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(normalize.template(path).alias("template")).groupBy("template").agg(F.count("*").alias("n"))


@query
def page_query_keys(spark, sf_dir):
    q = query_of(F.split("url", "#")[0])
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit(404).alias("status"), q.alias("query"))
    return report.keys(rows)


@query
def log_line_bans(spark, sf_dir):
    """Each conversation's turns as lines of one of 50 ips, ten seconds apart."""
    rows = requests(spark, sf_dir).withColumns({
        "ip": F.concat(F.lit("198.51.100."), (F.col("conv_id") % 50).cast("string")), "line": F.col("conv_id") * 1000 + F.col("turn"),
        "ts": F.timestamp_seconds(F.unix_seconds(ts("2024-01-01 00:00:00")) + F.col("conv_id") * 60 + F.col("turn") * 10),
    })
    return named(enforce.line_bans(signatures.verdicts(rows), 900, order="line"))


@query
def client_address(spark, sf_dir):
    """Requests with the headers that proxies set, or some of them, or none."""
    rows = arrivals(spark, sf_dir)
    real = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" "), "ip", F.lit("\t"))).when(F.col("event_id") % 4 == 1, "")
    forwarded = F.when(F.col("event_id") % 4 <= 1, F.concat(F.lit(" 203.0.113."), (F.col("event_id") % 200).cast("string"), F.lit(" , 192.0.2.1"))).when(F.col("event_id") % 8 == 2, "")
    peer = F.when(F.col("event_id") % 3 == 0, F.concat("ip", F.lit(":4711"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[2001:db8::"), "status", F.lit("]:80"))).otherwise(F.col("ip"))
    return rows.select("event_id", client_ip(real, forwarded, peer).alias("client"))


@query
def since_argument(spark, sf_dir):
    """Each event's time in one of the nine layouts, or in none of them."""
    layouts = ["dd/MM/yyyy:HH:mm:ss '+0200'", "dd/MMM/yyyy:HH:mm:ss '-0330'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd/MM/yyyy:HH:mm:ss", "dd/MM/yyyy", "dd/MMM/yyyy:HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    text = F.lit("yesterday")
    for i, layout in enumerate(layouts):
        text = F.when(F.col("event_id") % 10 == i, F.date_format("t", layout)).otherwise(text)
    return testlog.access(spark, sf_dir).select("event_id", F.unix_seconds(since(text)).alias("since"))


@query
def report_total(spark, sf_dir):
    return report.total(failed(spark, sf_dir), report.ReportFilter(classes=(5,), start="2024-01-01 00:10:00", end="2024-01-01 00:59:00"))


@query
def request_parameters(spark, sf_dir):
    """Numbers, durations, times and lists as text, good and bad ones by event_id."""
    k, own = F.col("event_id"), F.col("event_id").cast("string")

    def of(*texts: Column | str) -> Column:
        return F.element_at(F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts]), (k % len(texts) + 1).cast("int"))

    limit, window, start, classes = of(own, "+7", "x9", "", "-3", "99999999999999999999"), of("90s", "1h30m", "-5s", "bad", "1.5m250ms", "0s", "5"), of(own, "soon", ""), of("4, 5,x", F.concat(own, F.lit(",,-1 ,2.5")), "", "a,b")
    return testlog.access(spark, sf_dir).select(
        "event_id", parameters.int_value(limit, 50).alias("limit_"), parameters.seconds_value(window, 60).alias("window_s"), F.unix_seconds(parameters.unix_value(start)).alias("start"),
        F.array_join(F.transform(parameters.int_list(classes), lambda n: n.cast("string")), "|").alias("classes"), F.array_join(parameters.text_list(classes), "|").alias("items"),
    )


@query
def templates_by_version(spark, sf_dir):
    """Templates by the settings in force at each request's time, of three versions."""
    start = 1_704_067_200
    versions = [settings.Version(i + 1, start + 1200 * i, c) for i, c in enumerate([config.Config(), config.Config(route_patterns=PATTERNS), config.Config(route_patterns=["/download/:token/file"], ignore_paths=["/signup"])])]
    return settings.templated(testlog.access(spark, sf_dir), versions, F.col("t")).select("event_id", "template", "version")


def bad_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals(spark, sf_dir).filter("status >= 500").withColumn("reason", F.col("status").cast("string"))


@query
def ban_changes(spark, sf_dir):
    changes = history.ban_changes(history.ban_history(bad_requests(spark, sf_dir), 120))
    return changes.select("ip", F.unix_micros("ts").alias("us"), "action", "reason")


@query
def blocked_asof(spark, sf_dir):
    return history.blocked_asof(arrivals(spark, sf_dir), history.ban_history(bad_requests(spark, sf_dir), 120)).select("event_id", "ip", "blocked")


@query
def trap_port_bans(spark, sf_dir):
    """Requests answered with 400 as connections to one of three ports."""
    hits = arrivals(spark, sf_dir).filter("status = 400").withColumn("port", (F.col("event_id") % 3 + 2222).cast("int"))
    return named(history.trap_bans(hits.withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts"))), 300))


@query
def guard_health(spark, sf_dir):
    decided = enforce.decisions(arrivals(spark, sf_dir).withColumn("block", F.col("status") == 500), 0.01, 3, 600, True)
    held = enforce.bans(bad_requests(spark, sf_dir), 900)
    return named(history.health(signatures.rule_count(), "enforce", decided, held, ts("2024-01-01 01:00:00")))


#: Parts of words, of which each pair is a keyword.
SYLLABLES = ["the", "an", "re", "in", "on", "er", "nd", "st", "es", "ti", "ha", "wh", "ou", "ed", "ea", "or", "at", "ing", "tion", "ly", "ble", "sh", "en", "éré", "ci", "ung"]


@query
def keyword_match_many(spark, sf_dir):
    """All pairs of syllables as keywords, in whole documents."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = signatures.present_many(F.lower("text"), [a + b for a in SYLLABLES for b in SYLLABLES])
    return rows.select("doc_id", F.coalesce(F.size(found), F.lit(0)).alias("n"), F.md5(F.coalesce(F.array_join(found, ","), F.lit(""))).alias("found_md5"))
