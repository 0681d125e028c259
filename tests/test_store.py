"""Stored cube, ticks over windows, and settings that change."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from edgelens.operators import alerts, rollup
from edgelens.plans import config, settings
from edgelens.sources.tail import TailSource
from edgelens.sources.versions import Versions
from edgelens.streaming import alerting, ingest, store

HOUR = 3600
START = 1_784_109_600  # an hour's start


def batch_of(spark, rows):
    """hits and failures of (second, path, status) of one site."""
    df = spark.createDataFrame([(s, p, c) for s, p, c in rows], "s long, path string, status int")
    recs = df.select(F.timestamp_seconds("s").alias("ts"), F.lit(0).alias("tz_offset_s"), F.lit("shop").alias("site"), F.concat(F.lit("10.0.0."), F.col("s") % 7).alias("ip"), F.lit("GET").alias("method"), "path", "path", F.lit("").alias("query"), "status").toDF("ts", "tz_offset_s", "site", "ip", "method", "path", "template", "query", "status")
    return {"hits": rollup.hits(recs), "failures": rollup.failures(recs)}


def test_versions_are_whole_and_written_once(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"), keep=3)
    assert v.latest() == (0, None)
    for i in range(5):
        assert v.put({"i": i}, i) == i + 1
    assert v.numbers() == [3, 4, 5] and v.latest() == (5, {"i": 4})
    with pytest.raises(FileExistsError):
        v.put({"i": 9}, 4)
    assert v.latest() == (5, {"i": 4})


def test_many_batches_leave_few_folders_and_count_once(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), fan=3)
    want = 0
    for i in range(14):
        rows = [(START + 600 * i + k, f"/p/{k}", 500 if k == 0 else 200) for k in range(4)]
        assert s.begun("run", i, lambda i=i: {"t": i}) == {"t": i}
        assert s.begun("run", i, lambda: {"t": -1}) == {"t": i}  # run again: its first facts
        s.add("run", i, batch_of(spark, rows))
        want += 4
        assert s.begun("run", i, lambda: {}) is None  # and then it counts
    assert s.begun("another", 0, lambda: {"t": 7}) == {"t": 7}  # another checkpoint starts from 0
    state = s.versions.latest()[1]
    assert len(state["hits"]) <= 6 and {e["level"] for e in state["hits"]} == {0, 1, 2}
    cube = ingest.cube(spark, str(tmp_path))
    assert cube.agg(F.sum("n")).first()[0] == want and cube.count() == want
    assert ingest.failures(spark, str(tmp_path)).count() == 14
    assert s.last() == START + 600 * 13
    hours = {p.rsplit("=", 1)[1] for p in s.paths("hits", since=START // HOUR + 1)}
    assert hours == {str(START // HOUR + 1), str(START // HOUR + 2)}


def test_readers_go_on_while_batches_are_merged_and_evicted(spark, tmp_path):
    now = [1000.0]
    s = store.Store(spark, str(tmp_path), fan=2, clock=lambda: now[0])
    s.add("r", 0, batch_of(spark, [(START, "/a", 200)]))
    reader = ingest.cube(spark, str(tmp_path))  # planned on the folders of this moment
    s.add("r", 1, batch_of(spark, [(START + HOUR, "/b", 200)]))
    assert s.versions.latest()[1]["retired"] and reader.count() == 1
    assert s.evict(START + 3 * HOUR, HOUR) == 2 and ingest.cube(spark, str(tmp_path)).isEmpty()
    assert reader.count() == 1
    now[0] += store.GRACE_S
    s.sweep()
    left = {name for _, _, files in os.walk(tmp_path / "hits") for name in files if name.endswith(".parquet")}
    assert s.versions.latest()[1]["retired"] == [] and not left


def test_a_batch_without_rows(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.add("r", 0, batch_of(spark, []))
    assert s.last() is None and ingest.cube(spark, str(tmp_path)).isEmpty() and s.begun("r", 0, dict) is None


def test_a_tick_reads_its_window_only_and_outlives_its_channel(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    for i in range(6):
        s.add("r", i, batch_of(spark, [(START + HOUR * i + k, "/a", 500) for k in range(30)]))
    sent = []

    def send(alert):
        sent.append(alert["id"])
        raise OSError("down")

    rule = alerts.AlertRule("errors", classes=(5,), window_s=120, threshold=30, cooldown_s=600)
    tick = alerting.Tick(str(tmp_path), [rule], send, clock=lambda: 0.0)
    now = s.last()
    for seconds, hours in ((120, 2), (HOUR, 2), (3 * HOUR, 4)):  # however much history there is
        files = tick.window(spark, now, seconds).inputFiles()
        assert len(files) == hours and all(int(f.split("hour=")[1].split("/")[0]) >= (now - seconds) // HOUR for f in files)
    assert [a["id"] for a in tick.run(spark)] == ["errors"] and tick.failed[0][1] == "down"
    assert tick.run(spark) == [] and sent == ["errors"]  # in its cooldown, though it wasn't sent


def test_ticks_by_the_clock(spark, tmp_path):
    out, sent = str(tmp_path / "out"), []
    s = store.Store(spark, out)
    tick = alerting.Tick(out, [alerts.AlertRule("errors", classes=(5,), window_s=120, threshold=5)], sent.append, every_s=0)
    query = alerting.every(spark, tick, 0.3, str(tmp_path / "at"))
    try:
        s.add("r", 0, batch_of(spark, [(START + k, "/a", 500) for k in range(9)]))
        ends = time.time() + 60
        while not sent and time.time() < ends:
            time.sleep(0.2)
        assert query.exception() is None
    finally:
        query.stop()
    assert [a["id"] for a in sent] == ["errors"]


def test_ticks_take_settings_in_force(spark, tmp_path):
    out, table, clock, sent = str(tmp_path / "out"), str(tmp_path / "settings"), [0.0], []
    s = store.Store(spark, out)
    rows = [(START + 60 * m + k, "/a", 200) for m in range(20) for k in range(25)] + [(START + 20 * 60 + k, "/a", 500) for k in range(30)]
    s.add("r", 0, batch_of(spark, rows))
    rule = config.Rule("errors", status_classes=[5], window="2m", threshold=30, cooldown="10m")
    odd = config.Anomaly(enabled=True, baseline="15m", eval="1m", cooldown="10m")
    settings.apply(spark, config.Config(rules=[rule]), table, 10)
    settings.apply(spark, config.Config(rules=[rule], anomaly=odd), table, 20)
    settings.apply(spark, config.Config(rules=[rule], anomaly=odd), table, 30)
    settings.apply(spark, config.Config(), table, 40)
    tick = alerting.Tick(out, [], sent.append, clock=lambda: clock[0], settings=table)

    def at(t):
        clock[0] = t
        return sorted(a.get("id") or f"{a['scope']}/{a['label']}" for a in tick.run(spark))

    assert at(5) == [] and at(10) == ["errors"]
    assert at(20) == ["/5xx", "shop/5xx"]  # the rule's cooldown goes on
    assert at(25) == [] and at(30) == ["/5xx", "shop/5xx"] and at(40) == []  # a new version's detector has no cooldowns


def test_settings_are_checked_and_kept_by_version(spark, tmp_path):
    table, sites = str(tmp_path / "settings"), str(tmp_path / "sites.json")
    with pytest.raises(ValueError, match="route_patterns"):
        settings.apply(spark, config.Config(route_patterns=["x"]), table, 1, sites)
    assert settings.all_versions(spark, table) == [] and not os.path.exists(sites)
    assert settings.apply(spark, config.Config(sites=[config.Site("a", "/a")]), table, 5, sites) == 1
    assert settings.apply(spark, config.Config(route_patterns=["/x/:y"], retention="2h"), table, 9, sites) == 2
    with pytest.raises(ValueError, match="before"):
        settings.apply(spark, config.Config(), table, 8)
    assert [settings.in_force(spark, table, t) for t in (4, 5, 8.9, 9, 99)] == [0, 1, 1, 2, 2]
    assert settings.version(spark, table, 2).config.retention_s() == 7200 and json.load(open(sites))["sites"] == []


LINE = '10.0.0.1 - - [15/Jul/2026:13:{:02}:05 +0000] "GET {} HTTP/1.1" 404 5 "-" "curl/8"\n'


def test_lines_before_and_after_a_change(spark, tmp_path):
    log, out, at, table = tmp_path / "a.log", str(tmp_path / "out"), str(tmp_path / "at"), str(tmp_path / "settings")
    spark.dataSource.register(TailSource)
    paths = ["/shop/12/items", "/api/9", "/health", "/shop/9/items"]
    configs = [config.Config(), config.Config(route_patterns=["/shop/:sku/items"], ignore_paths=["/health"]), config.Config(ignore_paths=["/api"])]
    want = []
    for i, c in enumerate(configs):
        settings.apply(spark, c, table)
        with log.open("a") as f:
            f.writelines(LINE.format(i, p) for p in paths)
        lines = spark.readStream.format("logtail").option("site", "shop").load(str(log))
        ingest.ingest(lines, out, at, trigger={"availableNow": True}, settings=table).awaitTermination(120)
        alone = spark.createDataFrame([(LINE.format(i, p).strip(), "shop") for p in paths], "value string, site string")
        cube = rollup.hits(ingest.records(alone, F.current_timestamp(), ignore=c.ignore_paths, patterns=c.route_patterns))
        want += map(tuple, cube.select("minute", "template", "n").collect())
    assert sorted(map(tuple, ingest.cube(spark, out).select("minute", "template", "n").collect())) == sorted(want)
    assert {t for _, t, _ in want} >= {"/shop/{id}/items", "/shop/{sku}/items", "/health", "/api/{id}"}


def test_templates_by_version(spark):
    rows = spark.createDataFrame([(t, p) for t in (5, 15, 25) for p in ("/shop/12/items", "/health", "/health/x")], "t long, path string")
    versions = [settings.Version(2, 20, config.Config(ignore_paths=["/health"])), settings.Version(1, 10, config.Config(route_patterns=["/shop/:sku/items"]))]
    got = settings.templated(rows, versions, F.timestamp_seconds("t")).collect()
    assert sorted((r.t, r.template, r.version or 0) for r in got) == [
        (5, "/health", 0), (5, "/health/x", 0), (5, "/shop/{id}/items", 0), (15, "/health", 1), (15, "/health/x", 1), (15, "/shop/{sku}/items", 1), (25, "/shop/{id}/items", 2),
    ]
