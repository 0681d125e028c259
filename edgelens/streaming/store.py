"""The stored cube and failures: hour partitions under a manifest, small batches merged while readers go on.

``out``/manifest has versions of one document that names the folders that count, and of each the hours it holds. A batch's
folders count from the manifest's next version on, hits and failures together. FAN folders of a level become one of the
next, so a batch is written again log(batches) times and few folders are there at any time. Folders that no longer count
stay for GRACE_S seconds for readers of an older version.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelens.operators import rollup
from edgelens.schema import FAILURES, HITS
from edgelens.sources.versions import Files, Versions

FAN, GRACE_S = 8, 600
#: The tables by name: schema, time column, and how several folders become one.
TABLES: dict[str, tuple[str, str, Callable[[DataFrame], DataFrame]]] = {"hits": (HITS, "minute", rollup.merged), "failures": (FAILURES, "ts", lambda df: df)}


class Store:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, out: str, fan: int = FAN, clock: Callable[[], float] = time.time):
        self.spark, self.out, self.fan, self.clock = spark, out.rstrip("/"), fan, clock
        self.versions = Versions(spark, f"{self.out}/manifest", keep=16)

    def _state(self) -> tuple[int, dict]:
        number, state = self.versions.latest()
        return number, state or {"hits": [], "failures": [], "retired": [], "runs": {}}

    # reading

    def paths(self, table: str, since: int | None = None, until: int | None = None) -> list[str]:
        """Folders of the hours (since 1970) from ``since`` on and before ``until``."""
        entries = self._state()[1][table]
        return [f"{self.out}/{table}/{e['name']}/hour={h}" for e in entries for h in e["hours"] if (since is None or int(h) >= since) and (until is None or int(h) < until)]

    def read(self, table: str, since_s: int | None = None) -> DataFrame:
        """The rows of a table; with ``since_s`` those of the hours from that second's on."""
        schema = TABLES[table][0]
        paths = self.paths(table, None if since_s is None else since_s // 3600)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def last(self, table: str = "hits") -> int | None:
        """The last time (a minute, for hits) that is held, in seconds, from the manifest alone."""
        return max((s for e in self._state()[1][table] for s in e["hours"].values()), default=None)

    # writing

    def begun(self, run: str, batch: int, facts: Callable[[], dict]) -> dict | None:
        """What a batch noted when it was run first (``facts``, asked once); None where the batch counts already."""
        number, state = self._state()
        known = state["runs"].get(run, {"done": -1, "batch": -1, "facts": {}})
        if batch <= known["done"]:
            return None
        if known["batch"] != batch:
            state["runs"][run] = known = {"done": known["done"], "batch": batch, "facts": facts()}
            self.versions.put(state, number)
        return known["facts"]

    def add(self, run: str, batch: int, tables: dict[str, DataFrame]) -> None:
        """Writes a batch's tables; they count together, and once, however often a batch is run."""
        number, state = self._state()
        for table, df in tables.items():
            if entry := self._written(table, f"{run}-{batch}", 0, df):
                state[table].append(entry)
        state["runs"][run] = {**state["runs"].get(run, {"batch": batch, "facts": {}}), "done": batch}
        self.versions.put(state, number)
        self.merge()

    def _written(self, table: str, name: str, level: int, df: DataFrame) -> dict | None:
        time_ = F.unix_seconds(TABLES[table][1])
        path = f"{self.out}/{table}/{name}"
        df.withColumn("hour", F.floor(time_ / 3600)).hint("rebalance", "hour").write.mode("overwrite").partitionBy("hour").parquet(path)
        if not any(n.startswith("hour=") for n in Files(self.spark, path).names()):
            Files(self.spark, path).delete("")
            return None
        rows = self.spark.read.schema(f"{TABLES[table][0]}, hour long").parquet(path).groupBy("hour").agg(F.max(time_).alias("last")).collect()
        return {"name": name, "level": level, "hours": {str(r["hour"]): r["last"] for r in rows}}

    def merge(self) -> int:
        """Merges FAN folders of one level as long as there are so many; how many merges that took."""
        done = 0
        for table, (schema, _, merged) in TABLES.items():
            while True:
                number, state = self._state()
                levels = [e["level"] for e in state[table]]
                level = next((x for x in sorted(set(levels)) if levels.count(x) >= self.fan), None)
                if level is None:
                    break
                some = [e for e in state[table] if e["level"] == level][: self.fan]
                paths = [f"{self.out}/{table}/{e['name']}/hour={h}" for e in some for h in e["hours"]]
                entry = self._written(table, f"merged-{number}", level + 1, merged(self.spark.read.schema(schema).parquet(*paths)))
                gone = {e["name"] for e in some}
                state[table] = [*([entry] if entry else []), *[e for e in state[table] if e["name"] not in gone]]
                self._retire(state, [f"{table}/{n}" for n in sorted(gone)])
                self.versions.put(state, number)
                done += 1
        self.sweep()
        return done

    def evict(self, now_s: int, retention_s: int) -> int:
        """Hours that lie before the retention's minute as a whole no longer count; how many folders of an hour went.

        ``rollup.evict`` leaves out the old minutes of the hour that stays.
        """
        number, state = self._state()
        cut, gone = (now_s - retention_s) // 3600, []
        for table in TABLES:
            for e in state[table]:
                old = [h for h in e["hours"] if int(h) < cut]
                gone += [f"{table}/{e['name']}/hour={h}" for h in old]
                e["hours"] = {h: s for h, s in e["hours"].items() if h not in old}
            state[table] = [e for e in state[table] if e["hours"]]
        if gone:
            self._retire(state, gone)
            self.versions.put(state, number)
        self.sweep()
        return len(gone)

    def _retire(self, state: dict, places: list[str]) -> None:
        state["retired"] += [[p, self.clock()] for p in places]

    def sweep(self) -> None:
        """Deletes what has not counted for GRACE_S seconds."""
        number, state = self._state()
        old = [p for p, at in state["retired"] if at <= self.clock() - GRACE_S]
        if old:
            for p in old:
                Files(self.spark, self.out).delete(p)
            state["retired"] = [x for x in state["retired"] if x[0] not in old]
            self.versions.put(state, number)
