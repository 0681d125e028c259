"""Connections to trap ports: a source that follows the log of a listener or a firewall by its own offsets."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

from edgelens.sources.tail import Range, TailReader, TailSource


def connection(line: str) -> tuple[datetime, str, int] | None:
    """Time, ip and port of ``{"ts": seconds or ISO time, "ip": address, "port": number}`` or ``seconds address port``; None where it is neither.

    An address may have its own port behind it, as a socket's name does.
    """
    try:
        if line.lstrip().startswith("{"):
            row = json.loads(line)
            ts, ip, port = row["ts"], str(row["ip"]), int(row["port"])
        else:
            ts, ip, port = line.split()
            port = int(port)
        try:
            at = datetime.fromtimestamp(float(ts), UTC)
        except ValueError:
            at = datetime.fromisoformat(str(ts))
            at = at if at.tzinfo else at.replace(tzinfo=UTC)
    except (ValueError, KeyError, TypeError, OverflowError, OSError):
        return None
    if ip.startswith("["):
        ip = ip[1:].split("]")[0]
    elif ip.count(":") == 1:
        ip = ip.split(":")[0]
    return (at, ip, port) if ip and 0 < port < 65536 else None


class TrapReader(TailReader):
    """A tail whose lines are connections to one of ``ports`` (none: any port)."""

    ports: frozenset[int] = frozenset()

    def read(self, partition: Range) -> Iterator[tuple]:
        for line, _, _ in super().read(partition):
            found = connection(line)
            if found and (not self.ports or found[2] in self.ports):
                yield found


class TrapSource(TailSource):
    """``spark.readStream.format("traplog").option("ports", "22,23").load("/var/log/trap.log")``: ts, ip and port of each connection.

    Options and offsets are those of ``logtail``; lines that can't be read are left out. What comes is for
    ``operators.history.trap_bans``, or as events (reason: the port) for ``streaming.guard.ban_changes``.
    """

    @classmethod
    def name(cls) -> str:
        return "traplog"

    def schema(self) -> str:
        return "ts timestamp, ip string, port int"

    def streamReader(self, schema) -> TrapReader:
        tail = super().streamReader(schema)
        reader = TrapReader("", "")
        reader.__dict__.update(tail.__dict__)
        reader.ports = frozenset(int(p) for p in (self.options.get("ports") or "").split(",") if p.strip())
        return reader
