"""Parameters of a request, as text, to values: what can't be read is the default, and bad items of a list are dropped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER, _UNIT = r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)", "(ns|us|µs|μs|ms|s|m|h)"
# Seconds of the units of a duration.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def _integer(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("long"))


def int_value(text: Column, default: int) -> Column:
    """A whole number with an optional sign."""
    return F.coalesce(_integer(text), F.lit(default).cast("long"))


def seconds_value(text: Column, default: float) -> Column:
    """Seconds of a duration above 0 like ``1h30m``, ``.5s`` or ``500ms``."""
    each = F.zip_with(F.regexp_extract_all(text, F.lit(_NUMBER + _UNIT), F.lit(1)), F.regexp_extract_all(text, F.lit(_NUMBER + _UNIT), F.lit(2)), lambda n, u: F.struct(n.alias("n"), u.alias("u")))
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x["n"].try_cast("double") * F.element_at(unit, x["u"]))
    return F.coalesce(F.when(text.rlike(rf"^\+?(?:{_NUMBER}{_UNIT})+\z") & (total > 0), total), F.lit(float(default)))


def unix_value(text: Column) -> Column:
    """The time of so many seconds since 1970; null where there is none."""
    return F.timestamp_seconds(_integer(text))


def text_list(text: Column) -> Column:
    """The items between commas, trimmed; blank ones are dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.btrim(p, F.lit(" \t\n\x0b\f\r"))), lambda p: p != "")


def int_list(text: Column) -> Column:
    """The whole numbers between commas."""
    return F.filter(F.transform(text_list(text), _integer), lambda n: n.isNotNull())
