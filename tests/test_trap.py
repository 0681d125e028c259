"""Connections to trap ports as a stream, and the stream of who is banned from when until when."""

import json
import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from edgelens.operators import history
from edgelens.sources.trap import TrapSource, connection
from edgelens.streaming import guard

T0 = 1_700_000_000


def test_connections():
    at = datetime.fromtimestamp(T0, UTC)
    for line in (f'{{"ts": {T0}, "ip": "1.2.3.4", "port": 22}}', f"{T0} 1.2.3.4 22", f"{T0}.0 1.2.3.4:5000 22", '{"ts": "2023-11-14T22:13:20", "ip": "1.2.3.4", "port": "22"}', '{"ts": "2023-11-14T23:13:20+01:00", "ip": "1.2.3.4", "port": 22}'):
        assert connection(line) == (at, "1.2.3.4", 22)
    assert connection(f"{T0} [2001:db8::1]:99 22")[1] == connection(f"{T0} 2001:db8::1 22")[1] == "2001:db8::1"
    for line in ("", "x", "{", '{"ts": 1}', "[1]", f"{T0} 1.2.3.4 0", f"{T0} 1.2.3.4 x", "soon 1.2.3.4 22", '{"ts": 1, "ip": "", "port": 5}', "1e99 1.2.3.4 22"):
        assert connection(line) is None


def test_trap_stream_to_bans(spark, tmp_path):
    spark.dataSource.register(TrapSource)
    log, out = tmp_path / "trap.log", str(tmp_path / "out")

    def go(*lines):
        with log.open("a") as f:
            f.writelines(f"{x}\n" for x in lines)
        hits = spark.readStream.format("traplog").option("ports", "22,23").option("positions", str(tmp_path / "positions")).load(str(log))
        query = hits.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return spark.read.parquet(out)

    assert go(f"{T0} 1.1.1.1 22", f"{T0} 9.9.9.9 80", "junk").count() == 1
    log.rename(tmp_path / "trap.log.1")
    hits = go(f"{T0 + 5} 1.1.1.1 23", json.dumps({"ts": T0 + 60, "ip": "1.1.1.1", "port": 23}), f"{T0 + 7} 2.2.2.2 22")
    assert sorted((r.ip, r.reason) for r in history.trap_bans(hits, 30).collect()) == [("1.1.1.1", "sentinel: trap port 22"), ("1.1.1.1", "sentinel: trap port 23"), ("2.2.2.2", "sentinel: trap port 22")]
    assert spark.read.format("traplog").load(str(log)).count() == 3


def streamed(spark, files, tmp_path, seconds):
    """The changes that streams of one file a batch give; the last file drives the watermark beyond everything."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "ip string, us long, reason string, lift boolean").withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03}"))
    schema = spark.read.parquet(str(tmp_path / "in/000")).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in/*")).withWatermark("ts", "0 seconds")
    query = guard.ban_changes(events, seconds).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return spark.read.parquet(str(tmp_path / "out"))


def test_streamed_changes_equal_batch_and_replay(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted([(rng.choice(["a", "b", "c", "", None]), (T0 + rng.randrange(500)) * 10**6 + i, rng.choice("xyz"), False) for i in range(120)], key=lambda r: r[1])
    end = [("z", (T0 + 2000) * 10**6, "last", False)]
    got = streamed(spark, [rows[:40], rows[40:80], rows[80:], end], tmp_path, 20)
    got = sorted(map(tuple, got.select("ip", F.unix_micros("ts"), "action", "reason").collect()))
    df = spark.createDataFrame(rows, "ip string, us long, reason string, lift boolean").withColumn("ts", F.timestamp_micros("us"))
    want = sorted(map(tuple, history.ban_changes(history.ban_history(df, 20)).select("ip", F.unix_micros("ts"), "action", "reason").collect()))
    assert [r for r in got if r[0] != "z"] == want and len(want) > 30


def test_bans_that_are_lifted(spark, tmp_path):
    s = 10**6
    first = [("a", 10 * s, "x", False), ("a", 15 * s, None, True), ("a", 16 * s, None, True), ("a", 20 * s, "y", False), ("b", 20 * s, "q", False)]
    got = streamed(spark, [first, [("b", 22 * s, "r", False)], [("b", 23 * s, None, True), ("c", 900 * s, "w", False)]], tmp_path, 30)
    got = sorted((r.ip, r.s, r.action) for r in got.select("ip", F.unix_seconds("ts").alias("s"), "action").collect())
    assert got == [("a", 10, "ban"), ("a", 15, "unban"), ("a", 20, "ban"), ("a", 50, "unban"), ("b", 20, "ban"), ("b", 23, "unban"), ("c", 900, "ban")]
