"""Paths to endpoint templates, and prefixes to ignore."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a generated path segment looks like.
UUID = r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
DIGITS = r"\A[0-9]+\z"
HEX = r"\A[0-9a-fA-F]{16,}\z"
TOKEN_BYTES = 12


def segments(path: Column) -> Column:
    """Parts between slashes; slashes at both ends don't count, empty parts inside do."""
    inner = F.btrim(path, F.lit("/"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "/"))


def classify(segment: Column) -> Column:
    """A placeholder for a segment that looks generated, else the segment."""
    token = (F.octet_length(segment) >= TOKEN_BYTES) & segment.rlike("[0-9]") & segment.rlike("[a-zA-Z]") & ~F.contains(segment, F.lit("-"))
    return F.when(segment.rlike(UUID), "{uuid}").when(segment.rlike(DIGITS), "{id}").when(segment.rlike(HEX), "{hash}").when(token, "{token}").otherwise(segment)


def heuristic(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.transform(segments(path), classify), "/"))


def _pattern(path: Column, pattern: str) -> Column:
    """The pattern's template where the path matches it, else null."""
    parts = [p for p in pattern.strip("/").split("/")] if pattern.strip("/") else []
    own = segments(path)
    tests = [F.size(own) == len(parts)] + [F.lower(F.get(own, F.lit(i))) == p.lower() for i, p in enumerate(parts) if not p.startswith(":")]
    template = "/" + "/".join(f"{{{p[1:]}}}" if p.startswith(":") else p for p in parts)
    return F.when(reduce(lambda a, b: a & b, tests), F.lit(template))


def template(path: Column, patterns: list[str] | None = None) -> Column:
    """The first matching pattern's template, else the heuristic one; patterns that don't start with / are skipped."""
    tried = [_pattern(path, p.strip()) for p in patterns or [] if p.strip().startswith("/")]
    return F.when(path.isin("", "/"), "/").otherwise(F.coalesce(*tried, heuristic(path)))


def ignored(path: Column, prefixes: list[str]) -> Column:
    """Whether the path is one of the prefixes or lies below one."""
    clean = []
    for p in prefixes:
        p = p.strip()
        if p.startswith("/"):
            clean.append(p.rstrip("/") or "/")
    return reduce(lambda a, b: a | b, [(path == p) | path.startswith(p + "/") for p in clean], F.lit(False))
