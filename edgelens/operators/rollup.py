"""The additive cube of hits, and the views that are answered from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgelens.functions.normalize import template
from edgelens.functions.parse import status_class

#: Limits of what an agent keeps.
MAX_IPS, MAX_TEMPLATES, MAX_EVENTS = 200_000, 500, 50_000


def templated(records: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    return records.withColumn("template", template(F.col("path"), patterns))


def hits(records: DataFrame) -> DataFrame:
    """Requests by minute, site, method, template, ip and status (see schema.HITS), from records with a template."""
    keys = [F.date_trunc("minute", "ts").alias("minute"), "site", "method", "template", "ip", "status"]
    return records.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merged(cubes: DataFrame) -> DataFrame:
    """One cube of the union of several."""
    return cubes.groupBy("minute", "site", "method", "template", "ip", "status").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


#: The names of what ``counts`` gives.
COUNTS = ["total", *[f"c{i}xx" for i in range(1, 6)]]


def counts() -> list[Column]:
    """total and c1xx to c5xx of hits; other statuses count in total alone."""
    k = status_class(F.col("status"))
    return [F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *[F.coalesce(F.sum(F.when(k == i, F.col("n"))), F.lit(0)).alias(f"c{i}xx") for i in range(1, 6)]]


def with_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({f"rate_{i}xx": F.when(F.col("total") > 0, F.col(f"c{i}xx") / F.col("total")).otherwise(0.0) for i in range(2, 6)})


def overview(cube: DataFrame) -> DataFrame:
    """One row of totals, rates, distinct ips and endpoints, and the sites in order.

    Distinct values are keys of groupings of their own, one below the other, so no row is multiplied.
    """
    narrow = cube.groupBy("ip", "site", "method", "template").agg(*counts())
    by_ip = narrow.groupBy("ip").agg(*[F.sum(c).alias(c) for c in COUNTS])
    ends = narrow.groupBy("site", "method", "template").agg(F.lit(1).alias("one"))
    zero = F.lit(0).cast("long")
    parts = by_ip.select(*COUNTS, F.col("ip").isNotNull().cast("long").alias("ips"), zero.alias("ends"), F.lit(None).cast("string").alias("site"))
    known = F.col("site").isNotNull() & F.col("method").isNotNull() & F.col("template").isNotNull()
    parts = parts.union(ends.select(*[zero.alias(c) for c in COUNTS], zero.alias("ips"), known.cast("long").alias("ends"), "site"))
    sums = [F.coalesce(F.sum(c), zero).alias(c) for c in COUNTS]
    row = parts.agg(*sums, F.coalesce(F.sum("ips"), zero).alias("distinct_ips"), F.coalesce(F.sum("ends"), zero).alias("distinct_endpoints"), F.array_join(F.array_sort(F.collect_set("site")), ",").alias("sites"))
    return with_rates(row)


def site_totals(cube: DataFrame) -> DataFrame:
    return with_rates(cube.groupBy("site").agg(*counts()))


def minute_series(cube: DataFrame, since: Column | None = None) -> DataFrame:
    """Counts of the minutes that have any, from ``since`` on."""
    return (cube if since is None else cube.filter(F.col("minute") >= since)).groupBy("minute").agg(*counts())


def minute_codes(cube: DataFrame) -> DataFrame:
    return cube.groupBy("minute", "status").agg(F.sum("n").alias("n"))


def _limited(df: DataFrame, limit: int) -> DataFrame:
    return df.limit(limit) if limit > 0 else df


def top_ips(cube: DataFrame, limit: int = 50) -> DataFrame:
    rows = cube.groupBy("ip").agg(*counts(), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.array_join(F.array_sort(F.collect_set("site")), ",").alias("sites"), F.countDistinct("template").alias("templates"))
    return with_rates(_limited(rows.orderBy(F.desc("total"), "ip"), limit))


def ip_detail(cube: DataFrame, ip: str) -> DataFrame:
    """The templates of one ip by hits."""
    return cube.filter(F.col("ip") == ip).groupBy("ip", "template").agg(F.sum("n").alias("hits")).orderBy(F.desc("hits"), "template")


def top_endpoints(cube: DataFrame, limit: int = 50) -> DataFrame:
    rows = cube.groupBy("site", "method", "template").agg(*counts(), F.countDistinct("ip").alias("distinct_ips"), F.max("last_ts").alias("last_ts"))
    return with_rates(_limited(rows.orderBy(F.desc("total"), "site", "method", "template"), limit))


def ip_templates(cube: DataFrame, cap: int = MAX_TEMPLATES) -> DataFrame:
    """Hits of the first ``cap`` templates of each ip, by first arrival and then by name."""
    rows = cube.groupBy("ip", "template").agg(F.sum("n").alias("hits"), F.min("first_ts").alias("first_ts"))
    rank = F.row_number().over(Window.partitionBy("ip").orderBy("first_ts", "template"))
    return rows.withColumn("i", rank).filter(F.col("i") <= cap).drop("i")


def evict(cube: DataFrame, now: Column, retention_s: int) -> DataFrame:
    """The cube without minutes before the retention's cut."""
    return cube.filter(F.col("minute") >= F.timestamp_seconds(F.unix_seconds(F.date_trunc("minute", F.timestamp_seconds(F.unix_seconds(now) - retention_s)))))


def newest_ips(cube: DataFrame, limit: int = MAX_IPS) -> DataFrame:
    """The ``limit`` ips seen last."""
    return cube.groupBy("ip").agg(F.sum("n").alias("total"), F.max("last_ts").alias("last_ts")).orderBy(F.desc("last_ts"), "ip").limit(limit)


def failures(records: DataFrame) -> DataFrame:
    """Requests that failed, one by one."""
    return records.filter("status >= 400").select("ts", "tz_offset_s", "site", "ip", "method", "path", "template", "query", "status")


def kept_of(n: int, cap: int) -> int:
    """How many of ``n`` arrivals are held if a tenth of ``cap`` is dropped whenever there are more than ``cap``."""
    drop = max(1, cap // 10)
    return n if n <= cap else n - -(-(n - cap) // drop) * drop


def capped_failures(failed: DataFrame, cap: int = MAX_EVENTS) -> DataFrame:
    """The failures that such a log still holds; arrival is by time, then by the other columns."""
    kept = kept_of(failed.count(), cap)
    order = ["ts", "site", "ip", "method", "path", "query", "status"]
    return failed.orderBy(*[F.desc(c) for c in order]).limit(kept)
