"""Continuous ingest: lines to the stored cube and the failures, by micro-batches that count once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgelens.functions.normalize import ignored
from edgelens.functions.parse import parse_lines
from edgelens.operators import rollup
from edgelens.plans import settings as versions
from edgelens.sources.versions import Files
from edgelens.streaming.store import Store


def records(lines: DataFrame, ingest_ts: Column, ignore: list[str] | None = None, since: Column | None = None, patterns: list[str] | None = None) -> DataFrame:
    """Lines to records with a template: parsed, without ignored paths, from ``since`` on."""
    rows = parse_lines(lines, ingest_ts).filter(~ignored(F.col("path"), ignore or []))
    return rollup.templated(rows if since is None else rows.filter(F.col("ts") >= since), patterns)


def ingest(lines: DataFrame, out: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None, settings: str | None = None, **options) -> StreamingQuery:
    """Start storing the cube and the failures of a stream of lines below ``out``; ``after`` sees each batch's cube.

    A batch that is run again counts once, takes the time of its first run for lines whose own can't be read, and the
    settings that it had then. ``settings`` is a table of versions (``plans.settings``): each batch takes the patterns and
    ignored paths in force when it is run first, and what its retention, if it has one, says goes after it. ``options`` go
    to ``records``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store, run = Store(spark, out), json.loads(Files(spark, checkpoint).text("metadata"))["id"]
        facts = store.begun(run, number, lambda: _facts(spark, settings))
        if facts is None:
            return
        own, config = dict(options), None
        if facts["version"]:
            config = versions.version(spark, settings, facts["version"]).config
            own |= {"patterns": config.route_patterns, "ignore": config.ignore_paths}
        rows = records(batch.select("value", "site"), F.timestamp_micros(F.lit(facts["t"])), **own).persist()
        try:
            store.add(run, number, {"hits": rollup.hits(rows), "failures": rollup.failures(rows)})
            if config and config.retention:
                store.evict(facts["t"] // 1_000_000, int(config.retention_s()))
            if after:
                after(rollup.hits(rows), number)
        finally:
            rows.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def _facts(spark: SparkSession, settings: str | None) -> dict:
    t = spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
    return {"t": t, "version": versions.in_force(spark, settings, t / 1e6) if settings else 0}


def evict_stored(spark: SparkSession, out: str, now: Column, retention_s: int) -> int:
    """Drops the hours that hold nothing of the retention any more; how many folders of an hour went.

    An hour that holds both stays as a whole, and ``rollup.evict`` leaves out its old minutes.
    """
    return Store(spark, out).evict(spark.range(1).select(F.unix_seconds(now)).first()[0], retention_s)


def cube(spark: SparkSession, out: str, since_s: int | None = None) -> DataFrame:
    """The cube of all batches so far, or of the minutes from ``since_s`` on, of which only the hours are read."""
    rows = Store(spark, out).read("hits", since_s)
    return rollup.merged(rows if since_s is None else rows.filter(F.col("minute") >= F.timestamp_seconds(F.lit(since_s))))


def failures(spark: SparkSession, out: str, since_s: int | None = None) -> DataFrame:
    rows = Store(spark, out).read("failures", since_s)
    return rows if since_s is None else rows.filter(F.col("ts") >= F.timestamp_seconds(F.lit(since_s)))


def compact(spark: SparkSession, out: str, to: str) -> None:
    """All batches as one cube, by hour, in a table of its own."""
    cube(spark, out).withColumn("hour", F.date_format("minute", "yyyyMMddHH")).repartition("hour").write.mode("overwrite").partitionBy("hour").parquet(to)
