"""The log source over rotation, replacement, growth, bounds, restarts and sites that come and go."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from edgelens.plans import config, settings
from edgelens.sources.tail import TailReader, TailSource, frozen
from edgelens.streaming import ingest

LINE = '10.0.0.1 - - [15/Jul/2026:13:{:02}:05 +0000] "GET {} HTTP/1.1" 200 5 "-" "curl/8"\n'


class Polls:
    """A reader's batches, as the engine takes them."""

    def __init__(self, reader, start=None):
        self.reader, self.at = reader, reader.initialOffset() if start is None else start

    def next(self):
        end = self.reader.latestOffset()
        out = [(r[1], r[0]) for part in self.reader.partitions(self.at, end) for r in self.reader.read(part)]
        self.at = json.loads(json.dumps(end))
        return out

    def lines(self):
        return [line for _, line in self.next()]


def append(path, text):
    with open(path, "a") as f:
        f.write(text)


@pytest.mark.parametrize("pattern", ["", "access.log", "access*"])
@pytest.mark.parametrize("newest", [False, True])
def test_a_renamed_file_is_read_on_and_nothing_comes_twice(tmp_path, pattern, newest):
    log = tmp_path / "access.log"
    append(log, "a\nb\n")
    polls = Polls(TailReader(os.path.join(str(tmp_path), pattern) if pattern else str(tmp_path), "s", newest=newest))
    assert polls.lines() == ["a", "b"]
    append(log, "c\n")
    assert polls.lines() == ["c"]
    append(log, "d\n")  # written before the rename, not read yet
    os.rename(log, tmp_path / "access.log.1")
    append(log, "e\n")
    assert sorted(polls.lines()) == ["d", "e"]
    append(tmp_path / "access.log.1", "late\n")
    os.rename(tmp_path / "access.log.1", tmp_path / "access.log.2")
    os.rename(log, tmp_path / "access.log.1")
    append(log, "f\n")
    assert sorted(polls.lines()) == ["f", "late"]
    os.remove(tmp_path / "access.log.2")
    assert polls.lines() == []


def test_files_cut_and_written_anew(tmp_path):
    log = tmp_path / "a.log"
    append(log, "one\ntwo\n")
    polls = Polls(TailReader(str(log), "s"))
    assert polls.lines() == ["one", "two"]
    with open(log, "r+") as f:  # cut and shorter
        f.truncate(0)
        f.write("x\n")
    assert polls.lines() == ["x"]
    with open(log, "r+") as f:  # cut, and longer than before by the time it is seen
        f.truncate(0)
        f.write("new first line\nnew second line\n")
    assert polls.lines() == ["new first line", "new second line"]
    with open(log, "r+") as f:
        f.truncate(0)
    assert polls.lines() == []
    append(log, "after\n")
    assert polls.lines() == ["after"]


def test_growth_behind_a_boundary_comes_next(tmp_path):
    log = tmp_path / "a.log"
    append(log, "a\nhalf")
    reader = TailReader(str(log), "s")
    start, end = reader.initialOffset(), reader.latestOffset()
    append(log, " line\nmore\n")
    assert [r[0] for p in reader.partitions(start, end) for r in reader.read(p)] == ["a"]
    assert [r[0] for p in reader.partitions(end, reader.latestOffset()) for r in reader.read(p)] == ["half line", "more"]
    assert [r[0] for p in reader.partitions(start, end) for r in reader.read(p)] == ["a"]  # a batch that is run again


def test_batches_are_bounded_and_whole(tmp_path):
    rng = random.Random(1)
    want = []
    for name in ("a", "b", "c"):
        own = [f"{name}{i} " + "x" * rng.choice([0, 5, 40, 300]) for i in range(400)]
        append(tmp_path / f"{name}.log", "".join(f"{x}\n" for x in own))
        want += own
    polls, got = Polls(TailReader(str(tmp_path), "s", most=3000)), []
    while found := polls.lines():
        assert sum(len(x) + 1 for x in found) <= 3000
        got += found
    assert sorted(got) == sorted(want)
    append(tmp_path / "a.log", "y" * 9000 + "\nz\n")  # a line beyond the bound comes alone
    assert [len(x) for x in polls.lines()] == [9000] and polls.lines() == ["z"]


def test_a_huge_file_takes_the_bound_first(tmp_path):
    log = tmp_path / "a.log"
    with open(log, "wb") as f:
        f.write(b"line\n" * 10)
        f.truncate(1 << 30)  # sparse
        f.seek(0, os.SEEK_END)
        f.write(b"\n")
    reader = TailReader(str(log), "s", most=20)
    start = reader.initialOffset()
    (part,) = reader.partitions(start, reader.latestOffset())
    assert part.end - part.start == 20


def test_a_restart_goes_on_with_bound_and_positions(tmp_path):
    logs, positions = tmp_path / "logs", str(tmp_path / "positions")
    logs.mkdir()
    append(logs / "a.log", "".join(f"{i}\n" for i in range(10)))
    polls = Polls(TailReader(str(logs), "s", most=8, positions=positions))
    assert polls.lines() == ["0", "1", "2", "3"]
    os.rename(logs / "a.log", logs / "a.log.1")
    again = Polls(TailReader(str(logs), "s", most=8, positions=positions), polls.at)
    assert again.lines() == ["4", "5", "6", "7"]
    blind = Polls(TailReader(str(logs), "s", most=8), again.at)  # no positions: no bound, but no line twice either
    assert blind.lines() == ["8", "9"]
    append(logs / "a.log.1", "x\n")
    assert blind.lines() == ["x"]


def test_sites_come_and_go_without_a_restart(tmp_path):
    settings = str(tmp_path / "settings.json")
    for name in ("shop", "blog"):
        (tmp_path / name).mkdir()
        append(tmp_path / name / "access.log", f"old {name}\n")
    shop, blog = config.Site("shop", str(tmp_path / "shop")), config.Site("", str(tmp_path / "blog" / "*.log"))
    config.save(config.Config(sites=[shop]), settings)
    polls = Polls(TailReader("", "", table=settings))
    assert polls.next() == [("shop", "old shop")]
    config.save(config.Config(sites=[shop, blog]), settings)
    assert polls.next() == []  # a new site starts at its end
    for name in ("shop", "blog"):
        append(tmp_path / name / "access.log", f"1 {name}\n")
    assert sorted(polls.next()) == [(blog.path, "1 blog"), ("shop", "1 shop")]
    append(tmp_path / "blog" / "later.log", "2 blog\n")  # a file that comes after the site did
    assert polls.next() == [(blog.path, "2 blog")]
    config.save(config.Config(sites=[blog]), settings)
    for name in ("shop", "blog"):
        append(tmp_path / name / "access.log", f"3 {name}\n")
    assert polls.next() == [(blog.path, "3 blog")]
    config.save(config.Config(sites=[shop, config.Site(blog.path, str(tmp_path / "blog"))]), settings)
    assert polls.next() == []  # back at its end, and a site with another path is another
    append(tmp_path / "shop" / "access.log", "4 shop\n")
    with open(settings, "w") as f:
        f.write('{"sites": [')  # half written: the sites stay
    assert polls.next() == [("shop", "4 shop")]


def test_stream_over_a_table_of_sites(spark, tmp_path):
    spark.dataSource.register(TailSource)
    table, out = tmp_path / "sites.json", str(tmp_path / "out")
    logs = {n: tmp_path / f"{n}.log" for n in ("a", "b")}
    for n, log in logs.items():
        append(log, f"{n}0\n")

    def go(*names):
        table.write_text(json.dumps([{"name": n, "path": str(logs[n])} for n in names]))
        lines = spark.readStream.format("logtail").option("sites", str(table)).option("positions", str(tmp_path / "positions")).load()
        query = lines.select("site", "value").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    assert go("a") == [("a", "a0")]
    assert go("a", "b") == [("a", "a0")]
    for n, log in logs.items():
        append(log, f"{n}1\n")
    assert go("a", "b") == [("a", "a0"), ("a", "a1"), ("b", "b1")]
    append(logs["a"], "a2\n")
    append(logs["b"], "b2\n")
    assert go("b") == [("a", "a0"), ("a", "a1"), ("b", "b1"), ("b", "b2")]


def test_files_that_go_before_they_are_read(tmp_path):
    log = tmp_path / "a.log"
    append(log, "a\n")
    for skip in (False, True):
        reader = TailReader(str(log), "s", skip_gone=skip)
        start, end = reader.initialOffset(), reader.latestOffset()
        (part,) = reader.partitions(start, end)
        os.rename(log, tmp_path / "b.log")
        assert [r[0] for r in reader.read(part)] == ["a"]
        os.rename(tmp_path / "b.log", log)
    os.remove(log)
    assert list(reader.read(part)) == []
    with pytest.raises(FileNotFoundError):
        list(TailReader(str(log), "s").read(part))


def test_options(tmp_path):
    for options in ({}, {"path": "p", "sites": "q"}):
        with pytest.raises(ValueError):
            TailSource(options).streamReader(None)
    append(tmp_path / "a.log", "a\nb")
    held = json.loads(frozen(str(tmp_path), "shop"))
    assert [f["at"] for f in held["sites"]["shop"]["files"].values()] == [2]


def test_a_running_stream_takes_up_sites_and_settings(spark, tmp_path):
    """One query, never stopped: a site is added, patterns change, the log is rotated, the first site goes."""
    spark.dataSource.register(TailSource)
    table, sites, out = str(tmp_path / "settings"), str(tmp_path / "sites.json"), str(tmp_path / "out")
    logs = {n: tmp_path / n / "access.log" for n in ("shop", "blog")}
    for log in logs.values():
        log.parent.mkdir()
        append(log, LINE.format(0, "/old/1"))
    both = [config.Site(n, str(log.parent)) for n, log in logs.items()]
    settings.apply(spark, config.Config(sites=both[:1]), table, sites=sites)
    lines = spark.readStream.format("logtail").option("sites", sites).option("maxbytes", "500").load()
    query = ingest.ingest(lines, out, str(tmp_path / "at"), trigger={"processingTime": "200 milliseconds"}, settings=table)

    def holds(want):
        ends, got = time.time() + 90, None
        while time.time() < ends and got != want:
            assert query.exception() is None
            time.sleep(0.3)
            got = sorted((r.site, r.template, r.n) for r in ingest.cube(spark, out).groupBy("site", "template").agg(F.sum("n").alias("n")).collect())
        assert got == want

    try:
        holds([("shop", "/old/{id}", 1)])
        settings.apply(spark, config.Config(sites=both, route_patterns=["/new/:what"]), table, sites=sites)
        time.sleep(4)  # the new site is met at its end
        for log in logs.values():
            append(log, "".join(LINE.format(m, "/new/x") for m in range(20)))
        holds([("blog", "/new/{what}", 20), ("shop", "/new/{what}", 20), ("shop", "/old/{id}", 1)])
        append(logs["shop"], LINE.format(30, "/new/y"))
        os.rename(logs["shop"], tmp_path / "shop" / "access.log.1")
        append(logs["shop"], LINE.format(31, "/new/z"))
        holds([("blog", "/new/{what}", 20), ("shop", "/new/{what}", 22), ("shop", "/old/{id}", 1)])
        settings.apply(spark, config.Config(sites=both[1:]), table, sites=sites)
        time.sleep(4)
        for log in logs.values():
            append(log, LINE.format(40, "/last"))
        holds([("blog", "/last", 1), ("blog", "/new/{what}", 20), ("shop", "/new/{what}", 22), ("shop", "/old/{id}", 1)])
    finally:
        query.stop()
