"""Query strings to keys and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _good(pair: Column) -> Column:
    return ~F.contains(pair, F.lit(";")) & ~pair.rlike("%(?![0-9A-Fa-f]{2})")


def pairs(query: Column) -> Column:
    """array<struct<k, v>> of the decoded pairs in order; pairs with a semicolon or a bad escape are left out."""
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & _good(p))
    return F.transform(parts, lambda p: F.struct(F.try_url_decode(F.split(p, "=", 2)[0]).alias("k"), F.try_url_decode(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit(""))).alias("v")))


def is_clean(query: Column) -> Column:
    """Whether every pair can be decoded."""
    return F.forall(F.split(query, "&"), lambda p: (p == "") | _good(p))


def values(query: Column, key: str) -> Column:
    """The key's decoded values in order, joined."""
    return F.array_join(F.transform(F.filter(pairs(query), lambda p: p["k"] == key), lambda p: p["v"]), " | ")


def raw_value(query: Column, key: str) -> Column:
    """The undecoded value of the first pair whose undecoded key is ``key``; empty where there is none."""
    hit = F.get(F.filter(F.split(query, "&"), lambda p: F.split(p, "=", 2)[0] == key), F.lit(0))
    return F.coalesce(F.get(F.split(hit, "=", 2), F.lit(1)), F.lit(""))


def printable(text: Column) -> Column:
    """No control character but tab, and none that a broken encoding left."""
    return ~text.rlike(r"[\x{FFFD}\p{Cc}&&[^\t]]")


def shown(query: Column, key: str) -> Column:
    """The value of a report's cell: decoded, or raw where that can't be printed and raw isn't empty."""
    value, raw = values(query, key), raw_value(query, key)
    return F.when(printable(value) | (raw == ""), value).otherwise(raw)
