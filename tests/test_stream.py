import gzip
import os

from pyspark.sql import functions as F

from edgelens.operators import alerts, rollup
from edgelens.sources.logs import probe, read_lines, with_history
from edgelens.sources.tail import Range, TailReader, TailSource
from edgelens.streaming import alerting, ingest

LINE = '10.0.0.{} - - [15/Jul/2026:13:04:05 +0000] "GET /api/users/{} HTTP/1.1" {} 512 "-" "curl/8"\n'


def ends(offset, site="s"):
    return {os.path.basename(f["path"]): f["at"] for f in offset["sites"][site]["files"].values()}


def test_offsets_stop_at_line_ends(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"one\ntwo\nthr")
    reader = TailReader(str(log), "s")
    start = reader.initialOffset()
    end = reader.latestOffset()
    assert ends(end) == {"a.log": 8}
    (part,) = reader.partitions(start, end)
    assert [r[0] for r in reader.read(part)] == ["one", "two"]
    log.write_bytes(b"one\ntwo\nthree\n")
    after = reader.latestOffset()
    (part,) = reader.partitions(end, after)
    assert [r[0] for r in reader.read(part)] == ["three"]
    log.write_bytes(b"new\n")  # replaced by a shorter file
    (part,) = reader.partitions(after, reader.latestOffset())
    assert [r[0] for r in reader.read(part)] == ["new"]
    log.write_bytes(b"one\ntwo\nthree\n")
    (part,) = TailReader(str(log), "s").partitions({str(log): 8}, reader.latestOffset())  # an earlier release's offsets
    assert [r[0] for r in reader.read(part)] == ["three"]
    assert [r[0] for r in reader.read(Range(str(log), 1, 4))] == []


def test_stream_equals_batch(spark, tmp_path):
    log = tmp_path / "logs" / "access.log"
    log.parent.mkdir()
    text = [LINE.format(i % 3, i, 500 if i % 4 == 0 else 200) for i in range(60)]
    spark.dataSource.register(TailSource)
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    for lo in (0, 20, 40):
        with log.open("a") as f:
            f.writelines(text[lo : lo + 20])
            f.write("half a li") if lo == 40 else None
        lines = spark.readStream.format("logtail").option("site", "shop").load(str(log))
        ingest.ingest(lines, out, at, trigger={"availableNow": True}).awaitTermination(120)
    got = ingest.cube(spark, out)
    batch = rollup.hits(ingest.records(read_lines(spark, str(log), "shop"), F.current_timestamp()))
    key = ["minute", "template", "ip", "status", "n"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))
    assert got.agg(F.sum("n")).first()[0] == 60
    assert ingest.failures(spark, out).count() == 15


def test_gzip_and_probe(spark, tmp_path):
    with gzip.open(tmp_path / "a.log.gz", "wt") as f:
        f.write(LINE.format(1, 2, 200) + "junk\n")
    lines = read_lines(spark, str(tmp_path), "s")
    row = probe(lines, ingest.records(lines, F.current_timestamp()))
    assert (row["lines"], row["parsed"], row["ok"], len(row["sample"])) == (2, 1, True, 2)


def test_alert_ticks_cool_down_and_old_batches_go(spark, tmp_path):
    log = tmp_path / "access.log"
    spark.dataSource.register(TailSource)
    out, at, sent = str(tmp_path / "out"), str(tmp_path / "at"), []
    rules = [alerts.AlertRule("flood", metric="ip_request_count", window_s=3600, threshold=15, cooldown_s=600), alerts.AlertRule("errors", classes=(5,), window_s=120, threshold=5, cooldown_s=0)]

    def go(number, minute):
        with log.open("a") as f:
            f.writelines(LINE.format(1, i, 500 if i < 6 else 200).replace("13:04", f"13:{minute:02}") for i in range(20))
        tick = alerting.Tick(out, rules, sent.append, every_s=0)  # a new one each time, as after a restart
        lines = spark.readStream.format("logtail").option("site", "shop").load(str(log))
        ingest.ingest(lines, out, at, after=tick, trigger={"availableNow": True}).awaitTermination(120)
        return [a["id"] for a in sent]

    assert go(0, 4) == ["flood", "errors"]
    assert go(1, 9) == ["flood", "errors", "errors"]
    assert go(2, 14) == ["flood", "errors", "errors", "flood", "errors"]
    assert alerting.Tick(out, rules, sent.append, every_s=60, clock=lambda: 5.0).last is None
    ts = F.lit("2026-07-15 15:15:00").cast("timestamp")
    assert ingest.evict_stored(spark, out, ts, 3 * 3600) == 0
    assert ingest.cube(spark, out).agg(F.sum("n")).first()[0] == 60
    assert ingest.evict_stored(spark, out, ts, 3600) == 6  # the hour of three batches' hits and failures
    assert ingest.cube(spark, out).isEmpty()


def test_tail_from_the_end_and_long_lines(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"old\n")
    assert ends(TailReader(str(log), "s", at_end=True).initialOffset()) == {"a.log": 4} and ends(TailReader(str(log), "s").initialOffset()) == {}
    log.write_bytes(b"x" * 50 + b"\nshort\n")
    (part,) = TailReader(str(log), "s").partitions({}, TailReader(str(log), "s").latestOffset())
    assert [len(r[0]) for r in TailReader(str(log), "s", line=10).read(part)] == [5]
    assert [len(r[0]) for r in TailReader(str(log), "s", line=0).read(part)] == [50, 5]
    made = TailSource({"path": "p", "maxline": "0", "start": "end", "maxbytes": "7", "positions": "q", "gone": "skip"}).streamReader(None)
    assert (made.pattern, made.site, made.line, made.at_end, made.newest, made.most, made.positions, made.skip_gone) == ("p", "p", 0, True, False, 7, "q", True)


def test_only_the_newest_file_is_followed(tmp_path):
    for i, name in enumerate(["a.log", "b.log", "c.log.gz"]):
        (tmp_path / name).write_bytes(b"x\n")
        os.utime(tmp_path / name, (100 - i if name != "c.log.gz" else 500,) * 2)
    reader = TailReader(str(tmp_path), "s", newest=True)
    start = reader.initialOffset()
    assert [r.path for r in reader.partitions(start, reader.latestOffset())] == [str(tmp_path / "a.log")]
    none = TailReader(str(tmp_path / "none*"), "s", newest=True)
    assert none.partitions(none.initialOffset(), none.latestOffset()) == []


def test_history_joins_the_tail_without_gap_or_overlap(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    with gzip.open(folder / "access.log.1.gz", "wt") as f:
        f.write("old\n")
    log = folder / "access.log"
    log.write_text("one\ntwo\nhalf a ")
    held, stream = with_history(spark, str(folder), "shop")

    def tailed():
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect())

    with log.open("a") as f:
        f.write("line\nthree\n")
    assert sorted(map(tuple, held.collect())) == [("old", "shop"), ("one", "shop"), ("two", "shop")]
    assert tailed() == ["half a line", "three"]
    with log.open("a") as f:
        f.write("four\n")
    assert tailed() == ["four", "half a line", "three"]
