"""Series of fixed shape: charts of equal buckets and dense minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelens.operators.rollup import counts

#: Seconds from 0001-01-01, a Monday, to 1970-01-01; weeks and odd bucket lengths are counted from there.
ORIGIN = 62_135_596_800


def floor_local(seconds: int, bucket: int, offset: int = 0) -> int:
    """The bucket's start in local wall time, as seconds since 1970."""
    return (seconds + offset + ORIGIN) // bucket * bucket - ORIGIN - offset


def frame(low: int, high: int, bucket: int, count: int, offset: int = 0, now: int | None = None) -> tuple[int, int]:
    """(start, number of buckets) of a chart over minutes ``low`` to ``high``, in seconds; anchored at ``now`` or behind the last minute."""
    end = high + 60 if now is None else now
    anchor = floor_local(end, bucket, offset)
    if anchor <= high:
        anchor += bucket
    if count <= 0:
        count = (anchor - floor_local(low, bucket, offset)) // bucket + 1
    return anchor - bucket * count, count


def series(cube: DataFrame, bucket_s: int = 60, count: int = 0, offset_s: int = 0, now_s: int | None = None) -> DataFrame:
    """bucket_start and counts of ``count`` buckets (0: as many as there is data for, and one before), zeros filled in.

    An empty cube gives no buckets.
    """
    bucket_s = bucket_s if bucket_s > 0 else 60
    low, high = cube.agg(F.unix_seconds(F.min("minute")), F.unix_seconds(F.max("minute"))).first()
    spark = cube.sparkSession
    if high is None:
        start, count = 0, 0
    else:
        start, count = frame(low, high, bucket_s, count, offset_s, now_s)
    at = F.floor((F.unix_seconds("minute") - start) / bucket_s)
    sums = cube.withColumn("i", at).filter((F.col("i") >= 0) & (F.col("i") < count)).groupBy("i").agg(*counts())
    spine = spark.range(count).withColumnRenamed("id", "i")
    names = ["total", *[f"c{i}xx" for i in range(1, 6)]]
    rows = spine.join(sums, "i", "left")
    return rows.select(F.timestamp_seconds(F.col("i") * bucket_s + start).alias("bucket_start"), *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def dense_minutes(cube: DataFrame, end: Column, minutes: int, scopes: DataFrame | None = None) -> DataFrame:
    """scope, minute and counts of the ``minutes`` minutes up to ``end``, for each site and for all (scope empty), zeros filled in."""
    last = F.date_trunc("minute", end)
    both = cube.withColumn("scope", F.explode(F.array(F.lit(""), F.col("site"))))
    scopes = both.select("scope").distinct() if scopes is None else scopes
    sums = both.groupBy("scope", "minute").agg(*counts())
    # Days first, then the minutes of each, so that no array grows with the span.
    day = F.explode(F.sequence(F.lit(0), F.lit((minutes - 1) // 1440)))
    back = F.explode(F.sequence(F.lit(0), F.least(F.lit(1439), F.lit(minutes - 1) - F.col("day") * 1440)))
    spine = scopes.withColumn("day", day).withColumn("back", back)
    spine = spine.select(*scopes.columns, F.timestamp_seconds(F.unix_seconds(last) - 60 * (F.col("day").cast("long") * 1440 + F.col("back"))).alias("minute"))
    rows = spine.join(sums, ["scope", "minute"], "left")
    return rows.select("scope", "minute", *[F.coalesce(n, F.lit(0)).alias(n) for n in ["total", *[f"c{i}xx" for i in range(1, 6)]]])
