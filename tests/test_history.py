"""Bans over time against their definitions, and folds by stretches against whole folds."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from edgelens.operators import enforce, fold, history

T0 = 1_700_000_000


def events(spark, n=600, ips=4, span=4000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", *[f"10.0.0.{k}" for k in range(ips)]]), None if rng.random() < 0.03 else T0 * 10**6 + rng.randrange(span) * 500_000, rng.choice("abc")) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, ip string, us long, reason string").repartition(5)
    return rows, df.withColumn("ts", F.timestamp_micros("us"))


def test_history_answers_who_is_banned(spark):
    rows, df = events(spark)
    bad = df.filter(F.col("event_id") % 5 == 0)
    got = {r.event_id: (r.blocked, r.us, r.until) for r in history.blocked_asof(df, history.ban_history(bad, 30)).select("event_id", "blocked", "us", F.unix_micros("banned_until").alias("until")).collect()}
    assert len(got) == len(rows)
    length = 30 * 10**6
    for i, ip, us, _ in rows:
        ends = [u + length for j, p, u, _ in rows if j % 5 == 0 and p and p == ip and u is not None and us is not None and u < us]
        until = max((e for e in ends if e > us), default=None)
        assert got[i][0] == (until is not None)
        # the end as known by then is that of a slice's last ban, or a later one of the same slice
        assert until is None or got[i][2] >= until
    assert 50 < sum(v[0] for v in got.values()) < 550


def test_changes_replay_to_active_bans(spark):
    rows, df = events(spark, 300, 3, 3000, 2)
    changes = history.ban_changes(history.ban_history(df, 40))
    assert {r.action: r.n for r in changes.groupBy("action").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(("ban", "unban"), changes.count() // 2)
    bans = [(ip, u) for _, ip, u, _ in rows if ip and u is not None]
    for second in range(0, 1600, 97):
        now = T0 * 10**6 + second * 10**6 + 250_000
        want = sorted({ip for ip, u in bans if u <= now < u + 40 * 10**6})
        assert sorted(r.ip for r in history.replayed(changes, F.timestamp_micros(F.lit(now))).collect()) == want


def test_changes_of_bans_that_meet(spark):
    rows = [("a", 0, "x"), ("a", 10, "y"), ("a", 20, "z"), ("a", 31, "w"), ("b", 5, "q"), ("b", 5, "p")]
    df = spark.createDataFrame(rows, "ip string, s long, reason string").withColumn("ts", F.timestamp_seconds("s"))
    got = history.ban_changes(history.ban_history(df, 10)).select("ip", F.unix_seconds("ts"), "action", "reason").collect()
    assert sorted(map(tuple, got)) == [("a", 0, "ban", "x"), ("a", 30, "unban", "x"), ("a", 31, "ban", "w"), ("a", 41, "unban", "w"), ("b", 5, "ban", "p"), ("b", 15, "unban", "p")]
    assert history.ban_changes(history.ban_history(df, 0)).isEmpty() and history.ban_history(df.filter("false"), 9).isEmpty()


def test_columns_of_the_same_names_and_no_bans(spark):
    df = spark.createDataFrame([("a", 1, True, "u")], "ip string, s long, blocked boolean, k string").withColumn("ts", F.timestamp_seconds("s"))
    (row,) = history.blocked_asof(df, history.ban_history(df.withColumn("reason", F.lit("r")).filter("false"), 9)).collect()
    assert row.asDict() == {"ip": "a", "s": 1, "k": "u", "ts": row.ts, "blocked": False, "banned_until": None}


def test_trap_ports(spark):
    rows = [("a", 0, 22), ("a", 5, 23), ("a", 10, 23), ("", 1, 22), (None, 1, 22), ("b", 3, 25), ("b", 3, 22)]
    hits = spark.createDataFrame(rows, "ip string, s long, port int").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r.ip, r.reason, r.until) for r in history.trap_bans(hits, 10).select("ip", "reason", F.unix_seconds("expires").alias("until")).collect())
    assert got == [("a", "sentinel: trap port 22", 10), ("a", "sentinel: trap port 23", 20), ("b", "sentinel: trap port 22", 13)]


def test_health(spark):
    decided = spark.createDataFrame([("banned",), ("allowed",), ("flagged",), ("limited",), ("blocked",)], "decision string")
    held = spark.createDataFrame([(5,), (15,)], "s long").select(F.timestamp_seconds("s").alias("expires"))
    row = history.health(3, "observe", decided, held, F.timestamp_seconds(F.lit(10))).first()
    assert (row.status, row.mode, row.rules, row.total, row.denied, row.flagged, row.active_bans) == ("ok", "observe", 3, 5, 3, 1, 1)
    counters = enforce.metrics(decided.withColumn("ip", F.lit("i"))).first()
    assert (counters.total, counters.denied, counters.flagged, counters.banned_ips) == (5, 3, 1, 1)


@pytest.mark.parametrize("seed", [3, 4])
def test_stretches_equal_the_whole_fold(spark, seed):
    rng = random.Random(seed)
    rows, now = [], [0.0] * 3
    for i in range(900):  # bursts and pauses, some requests at one time, without a time or without an ip
        k = rng.randrange(3)
        now[k] += rng.choice([0, 0.1, 1, 2, 7, 30, 60])
        rows.append((i, None if rng.random() < 0.02 else f"ip{k}", None if rng.random() < 0.02 else int((T0 + now[k]) * 10**6), rng.random() < 0.1))
    df = spark.createDataFrame(rows, "event_id long, ip string, us long, block boolean").withColumn("ts", F.timestamp_micros("us")).repartition(6)
    seconds = F.unix_micros("ts") / 1e6

    def whole(start, step, inputs, kind):
        return {r.event_id: r.v for r in fold.folded(df, ["ip"], [seconds, F.col("event_id"), F.col("block")], inputs, start, step, "v", kind).collect()}

    want = whole(*enforce.bucket_step(0.4, 3), [seconds], BooleanType())
    got = {r.event_id: r.allowed for r in enforce.rate_limited(df, 0.4, 3).collect()}
    assert got == {k: bool(v) for k, v in want.items()} and 0 < sum(got.values()) < len(rows)
    want = whole(*enforce.decision_step(0.4, 3, 20, True), [seconds, F.col("block")], StringType())
    got = {r.event_id: r.decision for r in enforce.decisions(df, 0.4, 3, 20, True).collect()}
    assert got == {k: v for k, v in want.items() if v is not None} and set(got.values()) == {"allowed", "limited", "blocked", "banned"}


def test_a_busy_key_with_pauses_is_several_groups(spark):
    rows = [("a", 100.0 * burst + i / 50) for burst in range(20) for i in range(50)]
    picked = spark.createDataFrame(rows, "k0 string, o0 double")
    groups = fold.stretches(picked, ["k0"], "o0", 9.0).groupBy("stretch").count().collect()
    assert len(groups) == 20 and {r["count"] for r in groups} == {50}
