"""Token buckets, bans and decisions over streams: the steps of ``edgelens.operators.enforce`` with keyed state.

State times out by processing time, for which Spark runs batches without data. A stream with the trigger ``availableNow``
ends only where spark.sql.streaming.noDataMicroBatches.enabled is false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from edgelens.operators import enforce

if TYPE_CHECKING:
    import pandas as pd

#: Milliseconds for which an ip's state is kept at least.
IDLE_MS = 300_000


def _stepped(rows: DataFrame, inputs: list[Column], start: tuple, step: Callable[..., tuple], idle: Callable[[tuple], float], name: str, kind: str, state: str) -> DataFrame:
    """ip, ts, event_id and ``name`` of each row, from ``step`` over each ip's rows.

    Rows of a micro-batch are taken in (ts, event_id) order, one ip's small columns at once. State that is idle for
    IDLE_MS of processing time, and for the seconds that ``idle`` says until it equals the start again, is dropped.
    """

    n = len(inputs)

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else start
        batch = pd.concat(list(frames)).sort_values(["ts", "event_id"], na_position="first")
        out = []
        for x in zip(*[batch[f"i{i}"].tolist() for i in range(n)], strict=True):
            now, value = step(now, *[None if v != v else v for v in x])  # a null number comes as NaN
            out.append(value)
        held.update(tuple(now))
        held.setTimeoutDuration(max(IDLE_MS, int(idle(now) * 1000) + 1))
        yield batch[["ip", "ts", "event_id"]].assign(**{name: out})

    picked = rows.filter(F.col("ip").isNotNull()).select("ip", "ts", "event_id", *[c.alias(f"i{i}") for i, c in enumerate(inputs)])
    schema = f"ip string, ts timestamp, event_id long, {name} {kind}"
    return picked.groupBy("ip").applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _seconds() -> Column:
    return F.unix_micros("ts") / 1e6


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """ip, ts, event_id and allowed of a stream of requests (ip, ts, event_id); a rate of 0 or less allows all.

    Requests without an ip give no row.
    """
    if rate <= 0:
        return requests.filter(F.col("ip").isNotNull()).select("ip", "ts", "event_id", F.lit(True).alias("allowed"))
    start, step = enforce.bucket_step(rate, burst)
    return _stepped(requests, [_seconds()], start, step, lambda s: (start[0] - s[0]) / rate, "allowed", "boolean", "tokens double, last double")


def decisions(scored: DataFrame, rate: float, burst: float, ban_s: int, enforcing: bool) -> DataFrame:
    """ip, ts, event_id and decision of a stream of requests (ip, ts, event_id, block), as ``enforce.decisions`` gives them.

    The state is an ip's bucket and the end of its ban; both lapse by the requests' times, and state that holds neither a
    ban nor a missing token is dropped.
    """
    start, step = enforce.decision_step(rate, burst, ban_s, enforcing)

    def idle(state: tuple) -> float:
        tokens, last, until = state
        return max((start[0] - tokens) / rate if rate > 0 else 0.0, 0.0 if last is None else until - last)

    block = F.coalesce(F.col("block"), F.lit(False))
    return _stepped(scored, [_seconds(), block], start, step, idle, "decision", "string", "tokens double, last double, until double")


def ban_changes(events: DataFrame, seconds: int) -> DataFrame:
    """ip, ts, action and reason of a stream of events (ip, ts, reason, and ``lift``: true takes a ban away): who is banned from when on, and until when.

    The stream needs a watermark on ts. A ban's end is a timer: the ``unban`` row comes when the watermark has passed it, or
    with a later event of the ip, and bears the ban's end as its ts. A ban that another one follows before or as it ends is
    prolonged without a row; one that arrives after a later ban has begun doesn't move that one's row. Events without an ip
    or a time give none. State is one number and a reason for each ip that is banned.
    """
    length = int(seconds) * 1_000_000
    named = "lift" in events.columns

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        until, reason = held.get if held.exists else (None, None)
        out = []
        if held.hasTimedOut:
            out.append((until, "unban", reason))
            until = None
        else:
            for t, why, lift in sorted(((t, w, bool(x)) for f in frames for t, w, x in zip(f["us"], f["reason"], f["lift"], strict=True)), key=lambda r: (r[0], r[2], r[1] or "")):
                if until is not None and t > until:
                    out.append((until, "unban", reason))
                    until = None
                if lift:
                    if until is not None:
                        out.append((t, "unban", reason))
                    until = None
                elif until is None:
                    out.append((t, "ban", why))
                    until, reason = t + length, why
                else:
                    until = max(until, t + length)
            if until is not None and until // 1000 < held.getCurrentWatermarkMs():
                out.append((until, "unban", reason))
                until = None
        if until is None:
            held.remove()
        else:
            held.update((until, reason))
            held.setTimeoutTimestamp(-(-until // 1000))
        yield pd.DataFrame({"ip": [key[0]] * len(out), "us": [x[0] for x in out], "action": [x[1] for x in out], "reason": [x[2] for x in out]})

    lift = F.coalesce(F.col("lift"), F.lit(False)) if named else F.lit(False)
    picked = events.filter((F.coalesce("ip", F.lit("")) != "") & F.col("ts").isNotNull() & F.lit(seconds > 0))
    picked = picked.select("ip", "ts", F.unix_micros("ts").alias("us"), "reason", lift.alias("lift"))
    found = picked.groupBy("ip").applyInPandasWithState(run, "ip string, us long, action string, reason string", "until long, reason string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("ip", F.timestamp_micros("us").alias("ts"), "action", "reason")
