"""Drill-down into failing requests: endpoints, query keys, rows, and CSV."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelens.functions.query_string import is_clean, pairs, shown


@dataclass(frozen=True)
class ReportFilter:
    """Which failures to report; empty strings and None don't restrict. classes are status div 100, not clamped."""

    site: str = ""
    method: str = ""
    endpoint: str = ""
    start: str | None = None
    end: str | None = None
    classes: tuple[int, ...] = field(default=(4, 5))

    def column(self) -> Column:
        test = F.floor(F.col("status") / 100).isin(*self.classes) if self.classes else F.lit(True)
        for name, value in (("site", self.site), ("method", self.method), ("template", self.endpoint)):
            if value:
                test &= F.col(name) == value
        if self.start is not None:
            test &= F.col("ts") >= F.lit(self.start).cast("timestamp")
        if self.end is not None:
            test &= F.col("ts") < F.lit(self.end).cast("timestamp")
        return test


def endpoints(failed: DataFrame, which: ReportFilter = ReportFilter()) -> DataFrame:
    rows = failed.filter(which.column()).groupBy("site", "method", "template")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("status").between(400, 499)).alias("c4xx"), F.count_if(F.col("status").between(500, 599)).alias("c5xx")).orderBy(F.desc("n"), "site", "method", "template")


def keys(failed: DataFrame, which: ReportFilter = ReportFilter()) -> DataFrame:
    """key, n and coverage of the query keys; a request with a pair that can't be decoded counts in the whole alone."""
    rows = failed.filter(which.column())
    found = F.when(is_clean(F.col("query")), F.array_distinct(F.transform(pairs(F.col("query")), lambda p: p["k"]))).otherwise(F.array().cast("array<string>"))
    total = rows.count()
    each = rows.select(F.explode(found).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return each.withColumn("coverage", F.col("n") / F.lit(max(1, total))).orderBy(F.desc("n"), "key")


def stamp(ts: Column, offset: Column) -> Column:
    """RFC 3339 in the zone the log had."""
    local = F.date_format(F.timestamp_seconds(F.unix_seconds(ts) + offset), "yyyy-MM-dd'T'HH:mm:ss")
    size = F.abs(offset)
    zone = F.format_string("%s%02d:%02d", F.when(offset < 0, "-").otherwise("+"), F.floor(size / 3600), F.floor(size % 3600 / 60))
    return F.concat(local, F.when(offset == 0, "Z").otherwise(zone))


def rows(failed: DataFrame, columns: list[str], which: ReportFilter = ReportFilter(), limit: int = 1000) -> DataFrame:
    """date, ip, status, method, endpoint and a column for each query key, newest first; keys are read after the limit."""
    order = [F.desc("ts"), "site", "ip", "method", "path", "query", "status"]
    some = failed.filter(which.column()).orderBy(*order)
    some = some.limit(limit) if limit > 0 else some
    return some.select(stamp(F.col("ts"), F.col("tz_offset_s")).alias("date"), "ip", "status", "method", F.col("template").alias("endpoint"), *[shown(F.col("query"), k).alias(k) for k in columns])


def total(failed: DataFrame, which: ReportFilter = ReportFilter()) -> DataFrame:
    """One row: how many failures a report has before its limit."""
    return failed.filter(which.column()).agg(F.count("*").alias("total"))


def as_json(table: DataFrame) -> DataFrame:
    """A table's rows as JSON texts (column json); nulls are written."""
    return table.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]), {"ignoreNullFields": "false"}).alias("json"))


def write_json(table: DataFrame, path: str) -> None:
    """A table of any size as files of JSON lines."""
    table.write.json(path, ignoreNullFields=False)


def to_csv(table: DataFrame) -> str:
    """A report, limited as it is, as CSV text with a header."""
    out = io.StringIO()
    write = csv.writer(out, lineterminator="\n")
    write.writerow(table.columns)
    write.writerows(["" if v is None else v for v in r] for r in table.collect())
    return out.getvalue()


def write_csv(table: DataFrame, path: str) -> None:
    """A report of any size as CSV files, with the same cells."""
    table.write.csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
