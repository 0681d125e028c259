import datetime as dt
import random

from pyspark.sql import functions as F

from edgelens.operators import alerts, enforce, report, rollup, series, signatures

START = dt.datetime(2026, 7, 15, 12, 0)


def records(spark, rows):
    """(minute, site, ip, path, query, status)"""
    data = [(START + dt.timedelta(minutes=m), 0, site, ip, "GET", path, query, status, 0, "", "") for m, site, ip, path, query, status in rows]
    return rollup.templated(spark.createDataFrame(data, "ts timestamp, tz_offset_s int, site string, ip string, method string, path string, query string, status int, bytes long, referer string, ua string"))


def test_grouping_and_rates(spark):
    cube = rollup.hits(records(spark, [(0, "s", "1.1.1.1", f"/p/{i}", "", s) for i, s in enumerate((200, 200, 404, 500))]))
    row = rollup.overview(cube).first()
    assert (row.total, row.rate_2xx, row.rate_4xx, row.rate_5xx, row.distinct_ips, row.distinct_endpoints, row.sites) == (4, 0.5, 0.25, 0.25, 1, 1, "s")
    assert rollup.ip_detail(cube, "1.1.1.1").collect()[0].hits == 4
    assert rollup.ip_detail(cube, "9.9.9.9").isEmpty()


def test_empty_cube(spark):
    cube = rollup.hits(records(spark, [(0, "s", "i", "/", "", 200)]).filter("false"))
    assert rollup.overview(cube).first().total == 0 and rollup.overview(cube).first().rate_2xx == 0
    assert series.series(cube, 60, 5).isEmpty() and alerts.anomaly_backtest(cube).isEmpty()


def test_newest_ips_and_retention(spark):
    cube = rollup.hits(records(spark, [(0, "s", "a", "/", "", 200), (5, "s", "b", "/", "", 200), (9, "s", "c", "/", "", 200)]))
    assert [r.ip for r in rollup.newest_ips(cube, 2).collect()] == ["c", "b"]
    assert rollup.evict(cube, F.lit("2026-07-15 12:10:30").cast("timestamp"), 300).count() == 2


def test_report(spark):
    rows = [(i, "s", "1.1.1.1", "/svc/pay", f"ihNo={i}&fundCode=7" + ("&apiKey=zz" if i < 2 else ""), 500) for i in range(3)]
    failed = rollup.failures(records(spark, [*rows, (3, "s", "1.1.1.1", "/svc/pay", "", 200), (4, "s", "2.2.2.2", "/other", "", 404)]))
    top = report.endpoints(failed).collect()
    assert [(r.template, r.n, r.c4xx, r.c5xx) for r in top] == [("/svc/pay", 3, 0, 3), ("/other", 1, 1, 0)]
    which = report.ReportFilter(endpoint="/svc/pay")
    assert {r.key: round(r.coverage, 3) for r in report.keys(failed, which).collect()} == {"ihNo": 1.0, "fundCode": 1.0, "apiKey": 0.667}
    table = report.rows(failed, ["ihNo", "apiKey"], which, 2)
    assert report.to_csv(table) == "date,ip,status,method,endpoint,ihNo,apiKey\n2026-07-15T12:02:00Z,1.1.1.1,500,GET,/svc/pay,2,\n2026-07-15T12:01:00Z,1.1.1.1,500,GET,/svc/pay,1,zz\n"


def test_zoned_stamp(spark):
    row = spark.range(1).select(report.stamp(F.lit("2026-07-15 12:00:00").cast("timestamp"), F.lit(19800)), report.stamp(F.lit("2026-07-15 12:00:00").cast("timestamp"), F.lit(-12600))).first()
    assert tuple(row) == ("2026-07-15T17:30:00+05:30", "2026-07-15T08:30:00-03:30")


def test_series_shape():
    noon = 1_784_116_800  # 2026-07-15 12:00 UTC, a Wednesday
    assert series.frame(noon, noon + 180, 240, 15) == (noon + 240 - 240 * 15, 15)
    assert series.frame(noon, noon, 60, 0) == (noon - 60 + 60, 1) or series.frame(noon, noon, 60, 0)[1] == 2
    start, count = series.frame(noon, noon, 604_800, 0)
    assert count == 2 and (start + 4 * 86400) % 604_800 == 604_800 - 3 * 86400 + 4 * 86400 - 604_800 or dt.datetime.fromtimestamp(start, dt.UTC).weekday() == 0
    assert dt.datetime.fromtimestamp(series.floor_local(noon, 86400, 19800) + 19800, dt.UTC).hour == 0


def traffic(spark, last, rate, minutes=60):
    rows = []
    for m in range(minutes):
        rows += [(m, "s", f"ip{i}", "/", "", 500 if i < rate else 200) for i in range(100)]
    ok, bad = last
    return rollup.hits(records(spark, rows + [(minutes, "s", f"ip{i}", "/", "", 500 if i < bad else 200) for i in range(ok + bad)]))


def fired(cube):
    rows = alerts.anomaly_backtest(cube, alerts.AnomalyConfig(eval_min=1), minutes=1).filter("fires and label = '5xx'")
    return sorted(r.scope for r in rows.collect())


def test_anomalies(spark):
    assert fired(traffic(spark, (98, 2), 2)) == []
    assert fired(traffic(spark, (60, 40), 1)) == ["", "s"]
    assert fired(traffic(spark, (2, 1), 1)) == []


def test_thresholds(spark):
    rule = alerts.AlertRule("r5", classes=(5,), window_s=120, threshold=5)
    assert alerts.status_alert(rollup.hits(records(spark, [(0, "s", "i", "/", "", 500)] * 4)), rule).isEmpty()
    row = alerts.status_alert(rollup.hits(records(spark, [(0, "s", "i", "/", "", 500)] * 5)), rule).first()
    assert row.value == 5 and row.message == "r5: 5 matching requests in 120s (threshold 5)"
    flood = alerts.AlertRule("fl", window_s=60, threshold=100)
    cube = rollup.hits(records(spark, [(0, "s", "1.2.3.4", "/", "", 200)] * 150))
    assert alerts.flood_alert(cube, flood).first().message == "fl: IP 1.2.3.4 made 150 requests in 60s (threshold 100)"
    assert alerts.window_status_count(rollup.hits(records(spark, [(0, "s", "i", "/", "", 500)] * 2)), [5, 5], 60).first().matched == 4


def test_cooldown_and_routing(spark):
    rows = spark.createDataFrame([("a", START + dt.timedelta(minutes=m)) for m in (0, 5, 10, 12, 20)], "k string, t timestamp")
    assert sorted(r.t.minute for r in alerts.cooled(rows, ["k"], "t", 600).collect()) == [0, 10, 20]
    sent = spark.createDataFrame([("x", None), ("y", ["mail", "fax"])], "id string, channels array<string>")
    assert sorted((r.id, r.channel) for r in alerts.routed(sent, ["mail", "hook"]).collect()) == [("x", "hook"), ("x", "mail"), ("y", "mail")]


def test_signatures(spark):
    rows = spark.createDataFrame(
        [(1, "/products", "id=5", "Mozilla/5.0"), (2, "/p", "id=1+UNION+ALL+SELECT+x", ""), (3, "/", "", "sqlmap/1.7"), (4, "/..%2f..%2fetc/passwd", "", ""), (5, "/", "", "${jndi:ldap://x}"), (6, None, "%zz", None)],
        "i int, path string, query string, ua string",
    )
    got = {r.i: (set(r.matches), r.block) for r in signatures.verdicts(rows).collect()}
    assert got[1] == (set(), False) and got[2] == ({"SQLI-001"}, True) and got[3] == ({"SCAN-001"}, True)
    assert got[4] == ({"TRAV-001", "FILE-001"}, True) and got[5] == ({"LOG4J-001"}, True) and got[6] == (set(), False)


def test_keywords_overlap(spark):
    row = spark.range(1).select(signatures.present(F.lit("ushers"), ["he", "she", "his", "hers", ""]), signatures.any_present(F.lit("ushers"), ["x", "hers"]), signatures.any_present(F.lit("ushers"), [])).first()
    assert sorted(row[0]) == ["he", "hers", "she"] and row[1] is True and row[2] is False


def test_token_bucket_and_decisions(spark):
    at = [0, 0, 0, 1.5, 1.6]
    rows = spark.createDataFrame([("ip", START + dt.timedelta(seconds=s), i, i == 3) for i, s in enumerate(at)], "ip string, ts timestamp, event_id long, block boolean")
    assert [r.allowed for r in enforce.rate_limited(rows, 1, 2).orderBy("event_id").collect()] == [True, True, False, True, False]
    assert all(r.allowed for r in enforce.rate_limited(rows, 0, 2).collect())
    assert [r.decision for r in enforce.decisions(rows, 1, 2, 60, True).orderBy("event_id").collect()] == ["allowed", "allowed", "limited", "banned", "banned"]
    assert [r.decision for r in enforce.decisions(rows, 0, 2, 60, False).orderBy("event_id").collect()] == ["allowed"] * 3 + ["flagged", "allowed"]


def test_folds_hold_no_array_of_an_ip(spark):
    rng = random.Random(2)
    at = sorted(rng.choice([rng.randrange(4000), rng.randrange(4000) / 8]) for _ in range(3000))
    rows = spark.createDataFrame([("hot", START + dt.timedelta(seconds=s), i, i % 97 == 0) for i, s in enumerate(at)], "ip string, ts timestamp, event_id long, block boolean")
    tokens, last, want = 3.0, None, []
    for s in at:
        tokens, last = min(3.0, tokens + (s - (s if last is None else last)) * 0.5), s
        want.append(tokens >= 1)
        tokens -= tokens >= 1
    limited, decided = enforce.rate_limited(rows, 0.5, 3), enforce.decisions(rows, 0.5, 3, 60, True)
    assert [r.allowed for r in limited.orderBy("event_id").collect()] == want and decided.count() == len(at)
    for df in (limited, decided):
        assert "collect_list" not in df._jdf.queryExecution().toString()


def test_bans(spark):
    rows = spark.createDataFrame([("a", START, "one"), ("a", START - dt.timedelta(minutes=5), "two"), ("", START, "x"), (None, START, "x")], "ip string, ts timestamp, reason string")
    (ban,) = enforce.bans(rows, 900).collect()
    assert (ban.ip, ban.reason, ban.expires) == ("a", "one", START + dt.timedelta(minutes=15))
    assert enforce.active(enforce.bans(rows, 900), F.lit(str(START + dt.timedelta(minutes=15))).cast("timestamp")).isEmpty()
    assert enforce.bans(rows, 0).isEmpty()


def test_json_rows_and_rule_count(spark):
    from edgelens.operators import report, signatures

    rows = spark.createDataFrame([(1, None), (2, 'a"b')], "n int, s string")
    assert [r.json for r in report.as_json(rows).collect()] == ['{"n":1,"s":null}', '{"n":2,"s":"a\\"b"}']
    assert signatures.rule_count() == 11 and signatures.rule_count([signatures.Rule("a", 1, enabled=False), signatures.Rule("b", 1)]) == 1


def test_folds_with_null_keys_ties_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    from edgelens.operators import alerts, enforce

    rows = spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 1, "x"), (3, None, 0, "x"), (4, "a", 100, None), (5, "b", 0, "x")], "event_id long, ip string, s long, row string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: (r.allowed, r.row) for r in enforce.rate_limited(rows, 0.01, 1).collect()}
    assert got == {1: (True, "x"), 2: (False, "x"), 3: (False, "x"), 4: (True, None), 5: (True, "x")}
    assert {r.event_id for r in alerts.cooled(rows, ["ip"], "ts", 50).collect()} == {1, 4, 5}
    assert enforce.rate_limited(rows.filter("false"), 0.01, 1).isEmpty()
    scored = rows.withColumn("score", F.lit(15))
    assert {(r.ip, r.event_id) for r in enforce.line_bans(scored, 50).collect()} == {("a", 1), ("a", 4), ("b", 5)}


def test_anomalies_of_slices_equal_one_window(spark, monkeypatch):
    """Against each minute's definition, with gaps, a stray date, and slices shorter than a baseline."""
    rng = random.Random(5)
    rows = []
    minutes = sorted(rng.sample(range(200), 120))
    for m in minutes:
        for site in ("a", "b"):
            if rng.random() < 0.85:
                bad = 0 if rng.random() < 0.8 else rng.randrange(9)
                rows += [(m, site, 500, bad), (m, site, 404, rng.randrange(3)), (m, site, 200, rng.randrange(3, 30))]
    rows.append((-29_000_000, "a", 500, 50))
    cube = spark.createDataFrame([r for r in rows if r[3]], "m long, site string, status int, n long").withColumn("minute", F.timestamp_seconds(1_752_000_000 + F.col("m") * 60))
    monkeypatch.setattr(alerts, "SLICE", 7)
    config = alerts.AnomalyConfig(baseline_min=20, eval_min=3, min_samples=10, sensitivity=1.0, floor=0.01)
    got = {(r.scope, r.label, r.m): r for r in alerts.anomaly_backtest(cube, config).withColumn("m", ((F.unix_seconds("minute") - 1_752_000_000) / 60).cast("long")).collect()}
    last, fired, want = max(r[0] for r in rows if r[3]), 0, set()
    for scope in ("", "a", "b"):
        own = [r for r in rows if scope in ("", r[1])]
        for label, k in (("5xx", 5), ("4xx", 4)):
            total, hit = {}, {}
            for m, _, status, n in own:
                total[m] = total.get(m, 0) + n
                hit[m] = hit.get(m, 0) + n * (status // 100 == k)
            for m in {m + d for m in total for d in range(3) if total[m] and m + d <= last}:
                samples, bad = (sum(x.get(j, 0) for j in range(m - 2, m + 1)) for x in (total, hit))
                rates = [hit[j] / total[j] for j in range(m - 22, m - 2) if total.get(j, 0) >= 5]
                want.add((scope, label, m))
                r = got[scope, label, m]
                assert (r.samples, r.baseline_minutes) == (samples, len(rates)) and abs(r.rate - bad / samples) < 1e-9
                mean = sum(rates) / len(rates) if rates else None
                upper = mean + (sum((x - mean) ** 2 for x in rates) / len(rates)) ** 0.5 if rates else None
                assert (r.upper is None) == (upper is None) and (upper is None or abs(r.upper - upper) < 1e-9)
                fires = len(rates) >= 5 and samples >= 10 and bad / samples >= 0.01 and bad / samples > upper
                assert r.fires == fires or abs(bad / samples - upper) < 1e-9
                fired += fires
    assert set(got) == want and fired > 10
    latest = {(r.scope, r.label): r.fires for r in alerts.anomaly_backtest(cube, config, minutes=1).collect()}
    assert latest == {(s, k): r.fires for (s, k, m), r in got.items() if m == last}
