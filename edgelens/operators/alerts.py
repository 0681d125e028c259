"""Threshold and anomaly rules over the cube, for one moment or for every minute, and cooldowns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from edgelens.functions.parse import status_class
from edgelens.operators.fold import folded
from edgelens.operators.rollup import counts


@dataclass(frozen=True)
class AlertRule:
    id: str
    metric: str = "status_count"  # or ip_request_count
    site: str = ""
    classes: tuple[int, ...] = ()
    window_s: int = 60
    threshold: int = 1
    cooldown_s: int = 600
    channels: tuple[str, ...] = ()


@dataclass(frozen=True)
class AnomalyConfig:
    baseline_min: int = 60
    eval_min: int = 2
    cooldown_s: int = 900
    min_samples: int = 20
    sensitivity: float = 3.0
    floor: float = 0.02


#: A baseline minute needs so many requests, and a baseline so many minutes.
MIN_REQUESTS, MIN_MINUTES = 5, 5
#: Minutes of a slice of a scope's history.
SLICE = 1440


def latest(cube: DataFrame) -> DataFrame:
    """One row: the last minute that has data."""
    return cube.agg(F.max("minute").alias("now"))


def _in_window(cube: DataFrame, window_s: int, now: Column | None = None) -> DataFrame:
    """Hits of the minutes in (now - window, now], now being the last minute with data unless given."""
    if now is None:
        now = F.timestamp_seconds(F.lit(latest(cube).select(F.unix_seconds("now")).first()[0]).cast("long"))
    low = F.timestamp_seconds(F.floor((F.unix_seconds(now) - window_s) / 60) * 60)
    return cube.filter((F.col("minute") > low) & (F.col("minute") <= F.date_trunc("minute", now)))


def window_status_count(cube: DataFrame, classes: list[int], window_s: int, site: str = "", now: Column | None = None) -> DataFrame:
    """One row: matched and total; a class that is listed twice counts twice."""
    rows = _in_window(cube if not site else cube.filter(F.col("site") == site), window_s, now) if now is not None else _in_window(cube, window_s).filter(F.lit(True) if not site else F.col("site") == site)
    k = status_class(F.col("status"))
    times = sum((F.when(k == c, 1).otherwise(0) for c in classes), F.lit(0))
    return rows.agg(F.coalesce(F.sum(F.col("n") * times), F.lit(0)).alias("matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def window_ip_counts(cube: DataFrame, window_s: int, now: Column | None = None) -> DataFrame:
    return _in_window(cube, window_s, now).groupBy("ip").agg(F.sum("n").alias("n"))


def status_alert(cube: DataFrame, rule: AlertRule, now: Column | None = None) -> DataFrame:
    """One row if the rule fires."""
    row = window_status_count(cube, list(rule.classes), rule.window_s, rule.site, now)
    where = f" on {rule.site}" if rule.site else ""
    message = F.format_string(f"{rule.id}: %d matching requests in {rule.window_s}s (threshold {rule.threshold}){where}", "matched")
    fires = (F.col("matched") >= rule.threshold) & F.lit(bool(rule.classes))
    return row.filter(fires).select(F.lit(rule.id).alias("id"), F.lit("threshold").alias("kind"), F.lit(rule.site).alias("site"), F.lit("status_count").alias("metric"), F.col("matched").cast("double").alias("value"), F.lit(float(rule.threshold)).alias("threshold"), message.alias("message"))


def flood_alert(cube: DataFrame, rule: AlertRule, now: Column | None = None) -> DataFrame:
    """One row if the busiest ip reaches the threshold; of equally busy ones the first in text order."""
    row = window_ip_counts(cube, rule.window_s, now).orderBy(F.desc("n"), "ip").limit(1).filter(F.col("n") >= rule.threshold)
    message = F.format_string(f"{rule.id}: IP %s made %d requests in {rule.window_s}s (threshold {rule.threshold})", "ip", "n")
    return row.select(F.lit(rule.id).alias("id"), F.lit("threshold").alias("kind"), "ip", F.lit("ip_request_count").alias("metric"), F.col("n").cast("double").alias("value"), F.lit(float(rule.threshold)).alias("threshold"), message.alias("message"))


def anomaly_backtest(cube: DataFrame, config: AnomalyConfig = AnomalyConfig(), minutes: int | None = None) -> DataFrame:
    """scope, label, minute and whether the rule fires there, for every minute of the data (or the last ``minutes``).

    A scope is a site, or all as an empty text. Minutes whose evaluation window holds no request of the scope have no row:
    nothing can fire there, and a stray date adds only its own minutes. Windows run within slices of SLICE minutes, to
    which the minutes before are given that a baseline reaches back to, so a scope's history is never one window partition.
    """
    empty = "scope string, label string, minute timestamp, baseline_minutes long, mean double, stddev double, rate double, samples long, upper double, fires boolean"
    last = latest(cube).select(F.unix_seconds("now")).first()[0]
    if last is None:
        return cube.sparkSession.createDataFrame([], empty)
    base = max(5, config.baseline_min)
    reach = config.eval_min + base - 1
    if minutes is not None:  # no more of the past than the last minutes' baselines need
        cube = cube.filter(F.col("minute") > F.timestamp_seconds(F.lit(last - 60 * (minutes + reach))))
    sums = cube.withColumn("scope", F.explode(F.array(F.lit(""), F.col("site")))).groupBy("scope", F.unix_seconds("minute").alias("s")).agg(*counts())
    # The minutes behind one with requests are evaluated too, as long as it is in their window.
    later = sums.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(config.eval_min - 1)))).withColumn("s", F.col("s") + 60 * F.col("k")).filter(F.col("s") <= last)
    own = F.col("k") == 0
    points = later.groupBy("scope", "s").agg(*[F.sum(F.when(own, F.col(c)).otherwise(0)).alias(c) for c in ("total", "c4xx", "c5xx")])
    minute = F.floor(F.col("s") / 60)
    dealt = points.withColumn("home", F.floor(minute / SLICE)).withColumn("slice", F.explode(F.sequence(F.col("home"), F.floor((minute + reach) / SLICE))))
    each = dealt.select("scope", "s", "total", "home", "slice", F.explode(F.array(F.struct(F.lit("5xx").alias("label"), F.col("c5xx").alias("hit")), F.struct(F.lit("4xx").alias("label"), F.col("c4xx").alias("hit")))).alias("x")).select("scope", "s", "total", "home", "slice", "x.*")
    by = Window.partitionBy("scope", "label", "slice").orderBy("s")
    before = by.rangeBetween(-reach * 60, -config.eval_min * 60)
    now = by.rangeBetween(-(config.eval_min - 1) * 60, 0)
    rate = F.when(F.col("total") >= MIN_REQUESTS, F.col("hit") / F.col("total"))
    rows = each.withColumn("r", rate).select(
        "scope", "label", F.timestamp_seconds("s").alias("minute"), (F.col("home") == F.col("slice")).alias("own"),
        F.count("r").over(before).alias("baseline_minutes"), F.avg("r").over(before).alias("mean"), F.stddev_pop("r").over(before).alias("stddev"),
        F.sum("hit").over(now).alias("hit"), F.sum("total").over(now).alias("samples"),
    )
    rows = rows.filter("own and samples > 0").withColumn("rate", F.col("hit") / F.col("samples")).withColumn("upper", F.col("mean") + config.sensitivity * F.col("stddev"))
    fires = (F.col("baseline_minutes") >= MIN_MINUTES) & (F.col("samples") >= config.min_samples) & (F.col("rate") >= config.floor) & (F.col("rate") > F.col("upper"))
    out = rows.withColumn("fires", F.coalesce(fires, F.lit(False))).drop("hit", "own")
    return out if minutes is None else out.filter(F.col("minute") > F.timestamp_seconds(F.lit(last - 60 * minutes)))


def cooled(fired: DataFrame, keys: list[str], time: str, cooldown_s: int) -> DataFrame:
    """The rows that are sent: of each key in time order, those that don't come within the cooldown of the one sent before.

    Rows of one key and time are sent together. A fold over each key's rows between pauses as long as the cooldown; those with
    a null key are not sent.
    """

    def step(state: tuple, t: int) -> tuple[tuple, bool]:
        (last,) = state
        send = last is None or t == last or t - last >= cooldown_s
        return (t if send else last,), send

    at = F.unix_seconds(time)
    return folded(fired.filter(F.col(time).isNotNull()), keys, [at], [at], (None,), step, "_sent", BooleanType(), gap=max(1.0, float(cooldown_s))).filter("_sent").drop("_sent")


def routed(alerts: DataFrame, enabled: list[str]) -> DataFrame:
    """A row for each alert and channel that is on; no channels means all of them, unknown ones are dropped."""
    on = F.array(*[F.lit(c) for c in enabled]).cast("array<string>")
    wanted = F.when(F.coalesce(F.size("channels"), F.lit(0)) <= 0, on).otherwise(F.array_intersect("channels", on))
    return alerts.withColumn("channel", F.explode(wanted))
