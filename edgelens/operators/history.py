"""Bans over time: their history, the changes of who is banned, and requests against the history.

A history row holds all bans of an ip whose times fall into one slice as long as a ban: they overlap, so they are one ban
from the first's time to the last's end. It is made by a sum before the shuffle, so an ip with very many bans is a row a
slice. Bans of unequal length are histories of their own, united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgelens.operators.alerts import cooled

#: Microseconds of a slice of time within which requests meet bans, and tasks that the requests of one ip and slice are dealt to.
SLICE_US, SALTS = 60_000_000, 4


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time))


def ban_history(requests: DataFrame, seconds: int) -> DataFrame:
    """ip, start, end and reason (the first ban's; of several at once the least) of the bans that requests (ip, ts, reason) bring about.

    Each bans its ip for ``seconds``. Empty ips, null times and lengths of 0 or less give no ban.
    """
    length = max(0, seconds) * 1_000_000
    rows = requests.filter((F.coalesce("ip", F.lit("")) != "") & F.col("ts").isNotNull() & F.lit(length > 0)).select("ip", _micros("ts").alias("t"), "reason")
    at = F.floor(F.col("t") / max(1, length))
    held = rows.groupBy("ip", at.alias("slice")).agg(F.min("t").alias("start"), (F.max("t") + length).alias("end"), F.min(F.struct("t", "reason")).alias("first"))
    return held.select("ip", F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), F.col("first.reason").alias("reason"))


def ban_changes(history: DataFrame) -> DataFrame:
    """ip, ts, action and reason: a ``ban`` row where an ip's ban begins and an ``unban`` row where it ends, for who enforces them.

    A ban that another one follows before or as it ends is prolonged and gives no row; its reason stays the first's.
    """
    own = Window.partitionBy("ip").orderBy("start", "end")
    until = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("opens", until.isNull() | (F.col("start") > until))
    rows = rows.withColumn("n", F.sum(F.col("opens").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy("ip", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("reason", F.struct("start", "end")).alias("reason"))
    rows = spans.select("ip", F.explode(F.array(F.struct(F.col("start").alias("ts"), F.lit("ban").alias("action")), F.struct(F.col("end").alias("ts"), F.lit("unban").alias("action")))).alias("x"), "reason")
    return rows.select("ip", "x.ts", "x.action", "reason")


def replayed(changes: DataFrame, now: Column) -> DataFrame:
    """The ips that are banned at a time, from the rows of ``ban_changes`` alone."""
    last = changes.filter(F.col("ts") <= now).groupBy("ip").agg(F.max_by("action", F.struct("ts", F.col("action") == "ban")).alias("action"))
    return last.filter("action = 'ban'").select("ip")


def blocked_asof(requests: DataFrame, history: DataFrame, slice_us: int = SLICE_US, salts: int = SALTS) -> DataFrame:
    """Adds blocked and banned_until to requests (ip, ts): whether a ban holds that began before the request, and its end as known then.

    Requests and bans are united, not joined: a ban goes to each slice of time that it reaches, the requests of a slice in
    order of time carry the last ban on, and those of a busy ip are dealt to a task a slice and salt. Requests without an
    ip or a time are not blocked. Columns of those names are replaced.
    """
    kept = [c for c in requests.columns if c.lower() not in ("blocked", "banned_until")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    known = F.col("ip").isNotNull() & F.col("ts").isNotNull()
    asked = requests.withColumn("_known", F.coalesce(known, F.lit(False)))
    salt = F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")
    ours = asked.filter("_known").select(F.col("ip").alias("k"), F.floor(_micros("ts") / slice_us).alias("slice"), salt.alias("salt"), _micros("ts").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("until"), row.alias("row"))
    slices = F.sequence(F.floor(_micros("start") / slice_us), F.floor((_micros("end") - 1) / slice_us))
    bans = history.select(F.col("ip").alias("k"), F.explode(slices).alias("slice"), _micros("start").alias("t"), _micros("end").alias("until"))
    bans = bans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("k", "slice", "salt", "t", F.lit(1).alias("kind"), "until", F.lit(None).cast(ours.schema["row"].dataType).alias("row"))
    # A ban of the request's own time comes behind it; of several, the one that ends last is carried.
    carried = F.max("until").over(Window.partitionBy("k", "slice", "salt").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    met = ours.union(bans).withColumn("until", carried).filter("kind = 0")
    blocked = F.coalesce(F.col("t") < F.col("until"), F.lit(False))
    found = met.select("row.*", blocked.alias("blocked"), F.when(blocked, F.timestamp_micros("until")).alias("banned_until"))
    rest = asked.filter("not _known").select(*[F.col(f"`{c}`") for c in kept], F.lit(False).alias("blocked"), F.lit(None).cast("timestamp").alias("banned_until"))
    return found.union(rest)


def trap_bans(hits: DataFrame, seconds: int) -> DataFrame:
    """ip, ts, reason and expires of the bans that connections to trap ports (ip, ts, port) bring about; those of a banned ip change nothing."""
    known = hits.filter((F.coalesce("ip", F.lit("")) != "") & F.lit(seconds > 0))
    first = known.groupBy("ip", "ts").agg(F.min("port").alias("port"))
    held = cooled(first, ["ip"], "ts", seconds)
    return held.select("ip", "ts", F.concat(F.lit("sentinel: trap port "), F.col("port").cast("string")).alias("reason"), F.timestamp_seconds(F.unix_seconds("ts") + seconds).alias("expires"))


def health(rules: int, mode: str, decided: DataFrame, held: DataFrame, now: Column) -> DataFrame:
    """One row: status, mode, rules, time, and of decided requests and bans the counters total, denied, flagged and active."""
    d, ends = F.col("decision"), F.col("expires")
    rows = decided.select("decision", F.lit(None).cast("timestamp").alias("expires")).union(held.select(F.lit(None).cast("string"), "expires"))
    counts = rows.agg(F.count("decision").alias("total"), F.count_if(d.isin("banned", "limited", "blocked")).alias("denied"), F.count_if(d == "flagged").alias("flagged"), F.count_if(ends > now).alias("active_bans"))
    return counts.select(F.lit("ok").alias("status"), F.lit(mode).alias("mode"), F.lit(rules).alias("rules"), now.alias("time"), "total", "denied", "flagged", "active_bans")
