"""Bans, token buckets and the decision on each request, as folds over each ip's requests in time order.

A fold reads one ip's sorted requests one by one with state of constant size; ``edgelens.streaming.guard`` runs the same
steps over streams. Where an ip makes a pause after which its bucket is full and no ban holds, a new stretch begins, which
is a group of its own; so only requests without such a pause go through one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from edgelens.operators.alerts import cooled
from edgelens.operators.fold import folded

#: Score from which a line of the log bans its ip.
LINE_SCORE = 15


def bans(requests: DataFrame, seconds: int) -> DataFrame:
    """ip, reason and expires of the ban that holds of each ip: the one that ends last; of those that end together the first.

    ``requests`` has ip, ts and reason. Empty ips and lengths of 0 or less give no ban.
    """
    rows = requests.filter((F.coalesce("ip", F.lit("")) != "") & F.lit(seconds > 0)).withColumn("expires", F.timestamp_seconds(F.unix_seconds("ts") + seconds))
    return rows.groupBy("ip").agg(F.max("expires").alias("expires"), F.min_by("reason", F.struct(-F.unix_seconds("expires"), F.col("reason"))).alias("reason")).select("ip", "reason", "expires")


def active(held: DataFrame, now: Column) -> DataFrame:
    """The bans that hold, soonest to expire first."""
    return held.filter(F.col("expires") > now).orderBy("expires", "ip")


def unblocked(requests: DataFrame, held: DataFrame) -> DataFrame:
    """The requests whose ip isn't banned at their time."""
    return requests.join(held.select("ip", "expires"), "ip", "left").filter(F.col("expires").isNull() | (F.col("ts") >= F.col("expires"))).drop("expires")


def line_bans(scored: DataFrame, seconds: int, threshold: int = LINE_SCORE, order: str = "event_id") -> DataFrame:
    """ip, ts, reason and expires of the bans that lines of the log bring about, from lines (ip, ts, score, order).

    A line counts from ``threshold`` on, whether its rules block or not; lines of an ip that is banned at their time are
    passed over, so a ban is not prolonged.
    """
    bad = scored.filter((F.col("score") >= threshold) & (F.coalesce("ip", F.lit("")) != "") & F.lit(seconds > 0))
    first = bad.groupBy("ip", "ts").agg(F.min(order).alias(order))
    held = cooled(first, ["ip"], "ts", seconds)
    return held.select("ip", "ts", order, F.lit("observer").alias("reason"), F.timestamp_seconds(F.unix_seconds("ts") + seconds).alias("expires"))


def _seconds() -> Column:
    return F.unix_micros("ts") / 1e6


def bucket_step(rate: float, burst: float) -> tuple[tuple, Callable[..., tuple]]:
    """Start and step of an ip's token bucket: (tokens, last time) and whether a request at t is allowed."""
    burst = max(1.0, float(burst))

    def step(state: tuple, t: float | None) -> tuple[tuple, bool]:
        tokens, last = state
        have = min(burst, tokens + (0.0 if t is None or last is None else max(0.0, t - last)) * rate)
        return (have - (1.0 if have >= 1 else 0.0), _later(last, t)), have >= 1

    return (burst, None), step


def full_after(rate: float, burst: float) -> float:
    """Seconds after which a bucket is full, whatever was taken from it, and one more; 1 without a bucket."""
    return max(1.0, float(burst)) / rate + 1 if rate > 0 else 1.0


def decision_step(rate: float, burst: float, ban_s: int, enforce: bool) -> tuple[tuple, Callable[..., tuple]]:
    """Start and step of an ip's decisions: (tokens, last time, end of its ban) and what becomes of a request at t."""
    burst = max(1.0, float(burst))

    def step(state: tuple, t: float | None, block: bool | None) -> tuple[tuple, str]:
        tokens, last, until = state
        if t is not None and t < until:
            return state, "banned"
        have = min(burst, tokens + (0.0 if t is None or last is None else max(0.0, t - last)) * rate) if rate > 0 else burst
        limited = have < 1
        what = "limited" if limited else ("blocked" if enforce else "flagged") if block else "allowed"
        if t is not None and what in ("limited", "blocked"):
            until = max(until, t + float(ban_s))
        return (have - (0.0 if limited else 1.0), _later(last, t), until), what

    return (burst, None, float("-inf")), step


def _later(last: float | None, t: float | None) -> float | None:
    """A request that arrives late doesn't set a bucket's time back."""
    return last if t is None else t if last is None else max(last, t)


def rate_limited(requests: DataFrame, rate: float, burst: float, order: str = "event_id") -> DataFrame:
    """Adds allowed to requests (ip, ts, order): a token bucket for each ip; a rate of 0 or less allows all."""
    if rate <= 0:
        return requests.withColumn("allowed", F.lit(True))
    found = folded(requests, ["ip"], [_seconds(), F.col(order)], [_seconds()], *bucket_step(rate, burst), "allowed", BooleanType(), gap=full_after(rate, burst))
    return found.withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def decisions(scored: DataFrame, rate: float, burst: float, ban_s: int, enforce: bool, order: str = "event_id") -> DataFrame:
    """Adds decision to requests (ip, ts, order, block): banned, limited, blocked, flagged or allowed.

    A request of a banned ip is denied first; one without a token is denied and bans its ip; one that the rules block is
    denied and bans its ip if ``enforce``, else flagged. A ban holds ``ban_s`` seconds.
    """
    start, step = decision_step(rate, burst, ban_s, enforce)
    found = folded(scored, ["ip"], [_seconds(), F.col(order), F.col("block")], [_seconds(), F.col("block")], start, step, "decision", StringType(), gap=max(full_after(rate, burst), float(max(0, ban_s)) + 1))
    return found.filter(F.col("ip").isNotNull())


def metrics(decided: DataFrame) -> DataFrame:
    d = F.col("decision")
    return decided.agg(F.count("*").alias("total"), F.count_if(d.isin("banned", "limited", "blocked")).alias("denied"), F.count_if(d == "flagged").alias("flagged"), F.countDistinct(F.when(d.isin("limited", "blocked"), F.col("ip"))).alias("banned_ips"))
