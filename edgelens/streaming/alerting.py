"""Alert rules over what ingest stores, evaluated in ticks, with cooldowns that outlive the stream."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgelens.operators import alerts
from edgelens.plans import settings as versions
from edgelens.sources.versions import Versions
from edgelens.streaming import ingest
from edgelens.streaming.store import Store

log = logging.getLogger(__name__)


class Tick:
    """For ``ingest``'s ``after``: evaluates the rules at the last minute that has data, every ``every_s`` seconds at most.

    ``send`` gets the alerts that are out of cooldown, as dicts; one that it fails on is logged, put into ``failed`` and not
    sent again, as its cooldown has begun. A cooldown is counted in the data's time, by rule and site, and kept in
    ``out``/cooldowns until it is over, so that a stream that starts again goes on with it. Of the stored cube only the
    hours of the windows are read, whatever else is there. Alerts are few: one a rule, and one a site and label for
    ``anomaly``.

    ``settings`` is a table of versions (``plans.settings``), in place of ``rules`` and ``anomaly``: every tick takes those in
    force. With a new version the detector starts anew, without cooldowns; those of rules go on.
    """

    def __init__(self, out: str, rules: list[alerts.AlertRule], send: Callable[[dict], None], anomaly: alerts.AnomalyConfig | None = None, every_s: float = 60, clock: Callable[[], float] = time.time, settings: str | None = None):
        self.out, self.rules, self.send, self.anomaly, self.every_s, self.clock, self.settings = out, rules, send, anomaly, every_s, clock, settings
        self.last: float | None = None
        self.failed: list[tuple[dict, str]] = []

    def __call__(self, batch: DataFrame, number: int) -> None:
        now = self.clock()
        if self.last is None or now - self.last >= self.every_s:
            self.last = now
            self.run(batch.sparkSession)

    def current(self, spark: SparkSession) -> tuple[int, list[alerts.AlertRule], alerts.AnomalyConfig | None]:
        """Version, rules and detector in force."""
        number = versions.in_force(spark, self.settings, self.clock()) if self.settings else 0
        if not number:
            return 0, self.rules, self.anomaly
        config = versions.version(spark, self.settings, number).config
        return number, config.alert_rules(), config.anomaly_config()

    def window(self, spark: SparkSession, now_s: int, seconds: int) -> DataFrame:
        """The stored cube of the minutes that a window of so many seconds up to the minute ``now_s`` can touch."""
        return ingest.cube(spark, self.out, (now_s - seconds) // 60 * 60)

    def firing(self, spark: SparkSession, now_s: int) -> list[tuple[str, int, dict]]:
        """(key, cooldown, alert) of what fires at a minute."""
        out = []
        version, rules, anomaly = self.current(spark)
        now = F.timestamp_seconds(F.lit(now_s))
        for r in rules:
            view = alerts.status_alert if r.metric == "status_count" else alerts.flood_alert
            out += [(f"{r.id}|{r.site}", r.cooldown_s, row.asDict()) for row in view(self.window(spark, now_s, r.window_s), r, now).collect()]
        if anomaly:
            span = 60 * (1 + anomaly.eval_min + max(5, anomaly.baseline_min))
            fired = alerts.anomaly_backtest(self.window(spark, now_s, span), anomaly, minutes=1).filter("fires")
            out += [(f"anomaly@{version}|{row['scope']}|{row['label']}", anomaly.cooldown_s, row.asDict()) for row in fired.collect()]
        return out

    def run(self, spark: SparkSession) -> list[dict]:
        """One tick; the alerts that were sent."""
        now = Store(spark, self.out).last()
        if now is None:
            return []
        kept = Versions(spark, f"{self.out}/cooldowns", keep=4)
        number, known = kept.latest()
        known = known or {}
        armed = [x for x in self.firing(spark, now) if x[0] not in known or now - known[x[0]][0] >= known[x[0]][1]]
        if armed:
            held = {k: v for k, v in known.items() if now - v[0] < v[1]} | {key: [now, cooldown] for key, cooldown, _ in armed}
            kept.put(held, number)
        for _, _, alert in armed:
            try:
                self.send(alert)
            except Exception as e:  # a channel that is down doesn't end the stream
                log.warning("alert %s was not sent: %s", alert.get("id", alert.get("label")), e)
                self.failed.append((alert, str(e) or type(e).__name__))
        return [alert for _, _, alert in armed]


def every(spark: SparkSession, tick: Tick, seconds: float, checkpoint: str) -> StreamingQuery:
    """Starts ticks by the clock, so that what came behind the last tick is seen though no batch follows.

    In place of ``ingest``'s ``after``: cooldowns have one writer.
    """
    beats = spark.readStream.format("rate").option("rowsPerSecond", "1").load()
    return beats.writeStream.foreachBatch(lambda batch, _: tick(batch, 0)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, int(seconds * 1000))} milliseconds").start()
