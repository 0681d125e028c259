"""A source that follows appended log files of one site or of a table of sites, and reads what they held up to frozen offsets."""

from __future__ import annotations

import glob
import json
import os
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes that one task reads; longer lines than LINE are left out unless the option maxline says otherwise.
CHUNK, LINE = 64 << 20, 1 << 20
#: Bytes at a file's start by which a file that was replaced in place is told.
HEAD = 256


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, site: str = "", node: str = ""):
        self.path, self.start, self.end, self.site, self.node = path, start, end, site, node


def last_line_end(path: str, start: int) -> int:
    """Behind the last line end at or after ``start``; ``start`` if there is none."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end > start:
            lo = max(start, end - (1 << 16))
            f.seek(lo)
            at = f.read(end - lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            end = lo
    return start


def _line_end_near(path: str, start: int, end: int, most: int) -> int:
    """A line end in (start, end], ``most`` bytes behind ``start`` at most, or else behind the one line that starts there."""
    if end - start <= most:
        return end
    with open(path, "rb") as f:
        hi = start + most
        while hi > start:
            lo = max(start, hi - (1 << 16))
            f.seek(lo)
            at = f.read(hi - lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            hi = lo
        f.seek(start + most)
        f.readline()
        return min(end, f.tell())


def _head(path: str, length: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(length))


def plain_files(pattern: str) -> list[str]:
    """The files of a file's name, a folder or a glob, but for gzip archives."""
    at = pattern if not os.path.isdir(pattern) else os.path.join(pattern, "*")
    return sorted(p for p in glob.glob(at) if os.path.isfile(p) and not p.endswith(".gz"))


def _nodes(paths: list[str]) -> dict[str, str]:
    """{inode: path}; of two names of one file the first."""
    out: dict[str, str] = {}
    for p in paths:
        try:
            out.setdefault(str(os.stat(p).st_ino), p)
        except FileNotFoundError:  # renamed just now; the next poll finds it
            pass
    return out


def _moved(node: str, path: str) -> str | None:
    """Where a followed file is now: under another name in its folder, or None."""
    try:
        with os.scandir(os.path.dirname(path) or ".") as entries:
            return next((e.path for e in entries if str(e.inode()) == node and e.is_file() and not e.name.endswith(".gz")), None)
    except FileNotFoundError:
        return None


class TailReader(DataSourceStreamReader):
    """Offsets are {"sites": {site: {"path": pattern, "files": {inode: file}}}}.

    A file is {"path", "from", "at", "gen", "head", "crc"}: its last name, where it was taken up, the bytes read, how often
    it was replaced in place, and the checksum of its first ``head`` bytes. A file keeps its inode when it is renamed, so it
    is read on under its new name and nothing comes twice. One that became shorter than its offset, or starts with other
    bytes, was replaced and is read from its start.
    """

    def __init__(self, pattern: str, site: str, line: int = LINE, at_end: bool = False, newest: bool = False, behind: dict | None = None, table: str = "", most: int = 0, positions: str = "", skip_gone: bool = False):
        self.pattern, self.site, self.line, self.at_end, self.newest, self.behind = pattern, site, line, at_end, newest, behind
        self.table, self.most, self.positions, self.skip_gone = table, most, positions, skip_gone
        self.base: dict | None = None

    def wanted(self) -> dict[str, str]:
        """{site: pattern}, from the table of sites if there is one, as it is now."""
        if not self.table:
            return {self.site: self.pattern}
        try:
            with open(self.table) as f:
                raw = json.load(f)
        except (OSError, ValueError):
            if self.base is None:
                raise
            return {site: held["path"] for site, held in self.base["sites"].items()}  # a table that can't be read changes nothing
        rows = raw.get("sites") or [] if isinstance(raw, dict) else raw
        out: dict[str, str] = {}
        for r in rows:
            if r.get("path"):
                out.setdefault(r.get("name") or r["path"], r["path"])
        return out

    def advanced(self, base: dict | None, at_end: bool, most: int = 0) -> dict:
        """The offset that follows ``base``: every file up to its last whole line, together about ``most`` bytes (0: all).

        A site that ``base`` doesn't know, or knows by another pattern, is new; ``at_end`` leaves out what its files hold.
        """
        known = base["sites"] if base else {}
        sites: dict[str, dict] = {}
        pending = []
        for site, pattern in self.wanted().items():
            before = known.get(site)
            if before is not None and before["path"] != pattern:
                before = None
            found = _nodes(plain_files(pattern))
            followed = before["files"] if before else {}
            for node, old in followed.items():
                if node not in found and (path := _moved(node, old["path"])):
                    found[node] = path
            newest = max(found.values(), key=os.path.getmtime) if found and self.newest and before is None else None
            files: dict[str, dict] = {}
            for node, path in found.items():
                try:
                    file = self._file(path, followed.get(node), before is None and (at_end or path != (newest or path)))
                    end = last_line_end(path, file["at"])
                except FileNotFoundError:  # moved since it was listed
                    if node in followed:
                        files[node] = followed[node]
                    continue
                files[node] = file
                if end > file["at"]:
                    pending.append((file, end))
            sites[site] = {"path": pattern, "files": files}
        share = max(1, most // max(1, len(pending)))
        for file, end in pending:
            file["at"] = _line_end_near(file["path"], file["at"], end, share) if most else end
            if file["head"] < HEAD:
                file["head"] = min(HEAD, file["at"])
                file["crc"] = _head(file["path"], file["head"])
        return {"sites": sites}

    @staticmethod
    def _file(path: str, old: dict | None, skipped: bool) -> dict:
        if old is None:
            at = last_line_end(path, 0) if skipped else 0
            head = min(HEAD, at)
            return {"path": path, "from": at, "at": at, "gen": 0, "head": head, "crc": _head(path, head)}
        if os.path.getsize(path) < old["at"] or _head(path, old["head"]) != old["crc"]:
            return {"path": path, "from": 0, "at": 0, "gen": old["gen"] + 1, "head": 0, "crc": 0}
        return {**old, "path": path}

    def _kept(self, end: dict) -> None:
        """Where the next batch starts, for a reader that is made anew: a checkpoint's offsets aren't told to it before."""
        self.base = end
        if self.positions:
            os.makedirs(self.positions, exist_ok=True)
            at = os.path.join(self.positions, "offset.json")
            with open(f"{at}.new", "w") as f:
                json.dump(end, f)
            os.replace(f"{at}.new", at)

    def initialOffset(self) -> dict:
        self.base = self.behind if self.behind is not None else self.advanced(None, True) if self.at_end else {"sites": {s: {"path": p, "files": {}} for s, p in self.wanted().items()}}
        if not self.at_end and self.behind is None and self.newest:
            self.base = self._but_newest()
        return self.base

    def _but_newest(self) -> dict:
        """All files at their ends but for each site's newest one, which is to be read from its start."""
        out = self.advanced(None, True)
        for site in out["sites"].values():
            if site["files"]:
                newest = max(site["files"].values(), key=lambda f: os.path.getmtime(f["path"]))
                newest |= {"from": 0, "at": 0, "head": 0, "crc": 0}
        return out

    def latestOffset(self) -> dict:
        if self.base is None and self.positions and os.path.exists(at := os.path.join(self.positions, "offset.json")):
            with open(at) as f:
                self.base = json.load(f)
        if self.base is None:  # a stream that goes on, of which nothing else is known here: no bound, and files as they are
            return {**self.advanced(None, False), "blind": True}
        return self.advanced(self.base, True, self.most)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for site, held in end["sites"].items():
            before = start.get("sites", {}).get(site)
            followed = before["files"] if before and before["path"] == held["path"] else {}
            for node, file in held["files"].items():
                begin = self._begin(followed.get(node), file, start, bool(end.get("blind")))
                out += [Range(file["path"], lo, min(file["at"], lo + CHUNK), site, node) for lo in range(begin, file["at"], CHUNK)]
        self._kept(end)
        return out

    @staticmethod
    def _begin(old: dict | None, file: dict, start: dict, blind: bool) -> int:
        if old is None:  # a checkpoint of an earlier release has {path: bytes}
            at = start.get(file["path"], file["from"]) if "sites" not in start else file["from"]
            return at if at <= file["at"] else 0
        if blind:
            return old["at"] if old["at"] <= file["at"] else 0
        return old["at"] if old["gen"] == file["gen"] else file["from"]

    def read(self, partition: Range) -> Iterator[tuple]:
        """Lines that start in [start, end); the first task of a file's new bytes begins at a line's start."""
        path = partition.path
        if partition.node and not (os.path.exists(path) and str(os.stat(path).st_ino) == partition.node):
            path = _moved(partition.node, path) or ""
            if not path:
                if self.skip_gone:
                    return
                raise FileNotFoundError(f"{partition.path} is gone before it was read up to {partition.end}; the option gone=skip goes on without it")
        with open(path, "rb") as f:
            if partition.start:
                f.seek(partition.start - 1)
                f.readline()  # up to the end of a line that began before, or of just the line end itself
            while f.tell() < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                if not self.line or len(line) <= self.line:
                    yield line.rstrip(b"\r\n").decode("utf-8", "replace"), partition.site, path

    def commit(self, end: dict) -> None:
        self.base = self.base or end


class FrozenReader(DataSourceReader):
    """The lines of files up to the offsets given, which a tail goes on from."""

    def __init__(self, tail: TailReader, until: dict):
        self.tail, self.until = tail, until

    def partitions(self) -> list[Range]:
        return self.tail.partitions({}, self.until)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.tail.read(partition)


class TailSource(DataSource):
    """``spark.readStream.format("logtail").option("site", "shop").load("/var/log/nginx/access.log")``.

    The path is a file, a folder or a glob that every executor can read; gzip archives are left to batch reads. Instead of
    it, the option ``sites`` names a JSON file: a list of {"name", "path"}, or an object with such a list ``sites``, as
    ``plans.config`` saves it. It is read anew for every micro-batch: a site that is added later starts at the end of what
    its files hold then, one that is removed, or gets another path, stops, and the stream goes on.

    Options: ``maxline`` (bytes of the longest line that is kept; 0: any), ``start`` (``end`` leaves out what the files hold
    when the stream starts for the first time), ``behind`` (offsets as JSON, from ``frozen``, at which it starts instead),
    ``live`` (``newest`` takes up only the plain file written last, and those that come later), ``maxbytes`` (about how many
    bytes a micro-batch takes, dealt to the files that have some), ``gone`` (``skip`` goes on without files that were
    deleted before they were read), ``positions``: a folder in which the source notes where the next batch starts. A stream
    that goes on from a checkpoint needs it to tell new sites, replaced files and ``maxbytes`` in its first batch; without
    it that batch takes all, and sites that came meanwhile from their start.

    A file that is renamed in its folder is read on under its new name. What is written to it after it was packed, deleted
    or moved elsewhere isn't seen. A file that is cut and grows beyond its old offset with the same first HEAD bytes between
    two polls is taken for the old one.

    ``spark.read`` gives the lines up to the offsets of the option ``until``, or up to now.
    """

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "value string, site string, path string"

    def reader(self, schema) -> FrozenReader:
        tail = self.streamReader(schema)
        tail.positions = ""
        return FrozenReader(tail, json.loads(self.options["until"]) if self.options.get("until") else tail.advanced(None, False))

    def streamReader(self, schema) -> TailReader:
        o = self.options
        pattern = o.get("path") or ""
        if bool(pattern) == bool(o.get("sites")):
            raise ValueError("logtail takes a path or a table of sites")
        longest, behind = o.get("maxline"), o.get("behind")
        line = 0 if longest == "0" else int(longest or LINE)
        return TailReader(
            pattern, o.get("site") or pattern, line, o.get("start") == "end", o.get("live") == "newest", json.loads(behind) if behind else None,
            o.get("sites") or "", int(o.get("maxbytes") or 0), o.get("positions") or "", o.get("gone") == "skip",
        )


def frozen(pattern: str, site: str = "") -> str:
    """Where each plain file's last whole line ends now, as JSON for the options ``until`` and ``behind``."""
    return json.dumps(TailReader(pattern, site or pattern).advanced(None, False))
