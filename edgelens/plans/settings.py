"""Settings that change while a stream runs: versions of an agent's settings, each valid from a time on."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelens.functions.normalize import ignored, template
from edgelens.plans import config
from edgelens.sources.versions import Versions


@dataclass(frozen=True)
class Version:
    number: int
    at: float
    config: config.Config


def apply(spark: SparkSession, new: config.Config, path: str, at: float | None = None, sites: str = "") -> int:
    """Puts settings in force from ``at`` (seconds; now, if not given) on, as the next version of the table at ``path``.

    Raises ValueError with all problems, and then nothing changes. ``sites`` is the file that a stream with the option
    ``sites`` of the log source follows: it is replaced, so that new sites are taken up and others stop.
    """
    if found := new.problems():
        raise ValueError("; ".join(f"{a}: {b}" for a, b in found))
    versions = Versions(spark, path)
    number, last = versions.latest()
    at = time.time() if at is None else at
    if last and at < last["at"]:
        raise ValueError("settings can't be in force before those they follow")
    number = versions.put({"at": at, "settings": asdict(new)}, number)
    if sites:
        config.save(new, sites)
    return number


def all_versions(spark: SparkSession, path: str) -> list[Version]:
    versions = Versions(spark, path)
    return [Version(n, d["at"], config.made(d["settings"])) for n in versions.numbers() for d in [versions.get(n)]]


def version(spark: SparkSession, path: str, number: int) -> Version:
    d = Versions(spark, path).get(number)
    return Version(number, d["at"], config.made(d["settings"]))


def in_force(spark: SparkSession, path: str, at: float) -> int:
    """The number of the version in force at a time; 0 before the first."""
    versions = Versions(spark, path)
    return next((n for n in reversed(versions.numbers()) if versions.get(n)["at"] <= at), 0)


def templated(records: DataFrame, versions: list[Version], at: Column) -> DataFrame:
    """Adds template and version (null before the first) to records by the patterns in force at ``at``, and leaves out what was ignored then.

    Versions are few and small: each is a branch of one expression, so nothing is joined or shuffled.
    """
    number, text, out = F.lit(None).cast("long"), template(F.col("path"), None), F.lit(False)
    for v in sorted(versions, key=lambda v: (v.at, v.number)):
        since = at >= F.timestamp_micros(F.lit(int(v.at * 1_000_000)))
        number = F.when(since, F.lit(v.number).cast("long")).otherwise(number)
        text = F.when(since, template(F.col("path"), v.config.route_patterns)).otherwise(text)
        out = F.when(since, ignored(F.col("path"), v.config.ignore_paths)).otherwise(out)
    return records.filter(~out).withColumns({"template": text, "version": number})
