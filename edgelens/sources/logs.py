"""Log files as lines."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelens.sources.tail import TailSource, frozen


def read_lines(spark: SparkSession, path: str | list[str], site: str) -> DataFrame:
    """value and site of each line of a file, of the files of a folder or of a glob; ``.gz`` files are unpacked.

    Plain files are split among tasks. Paths that don't exist give an error.
    """
    return spark.read.text(path).select("value", F.lit(site or str(path)).alias("site"))


def probe(lines: DataFrame, parsed: DataFrame, samples: int = 3) -> dict:
    """What a candidate log holds, before it is added: lines, parsed, ok, first and last time, and its first lines."""
    row = parsed.agg(F.count("*").alias("parsed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).first()
    return {"lines": lines.count(), "ok": row["parsed"] > 0, "sample": [r["value"] for r in lines.select("value").limit(samples).collect()], **row.asDict()}


def with_history(spark: SparkSession, path: str, site: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """The lines that a file, folder or glob holds now, archives included, and the stream of those that follow.

    Every line is in one of the two: the boundary is frozen before anything is read, at the end of each plain file's
    last whole line. A stream that starts again from a checkpoint goes on from there, so only a first start reads the
    history. ``options`` are those of the tail.
    """
    spark.dataSource.register(TailSource)
    own = {"site": site or path, **options}
    until = frozen(path, own["site"])
    held = spark.read.format("logtail").options(until=until, **own).load(path).select("value", "site")
    packed = sorted(p for p in glob.glob(os.path.join(path, "*") if os.path.isdir(path) else path) if p.endswith(".gz"))
    if packed:
        held = held.union(read_lines(spark, packed, own["site"]))
    return held, spark.readStream.format("logtail").options(behind=until, **own).load(path)
