"""Small JSON documents by version, in a folder of any file system that Spark can write."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Files:
    """A folder by Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.system = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.system.listStatus(self._at(""))) if self.system.exists(self._at("")) else []

    def text(self, name: str) -> str:
        stream = self.system.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Puts a whole file there at once; raises FileExistsError where one of that name is."""
        new = self._at(f".{name}.new")
        stream = self.system.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.system.exists(self._at(name)) or not self.system.rename(new, self._at(name)):
            raise FileExistsError(f"{self.path}/{name}: another writer was first")

    def delete(self, name: str) -> bool:
        return bool(self.system.delete(self._at(name), True))


class Versions:
    """Documents 1, 2, ... of a folder. A reader sees a whole version or the one before; a writer that isn't the first fails."""

    def __init__(self, spark: SparkSession, path: str, keep: int | None = None):
        self.files, self.keep = Files(spark, path), keep

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names() if n.endswith(".json") and n[0].isdigit())

    def get(self, number: int) -> Any:
        return json.loads(self.files.text(f"{number:012}.json"))

    def latest(self) -> tuple[int, Any]:
        """(0, None) where there is none yet."""
        found = self.numbers()
        return (found[-1], self.get(found[-1])) if found else (0, None)

    def put(self, document: Any, after: int) -> int:
        """The number of the new version, which follows ``after``; only ``keep`` versions stay."""
        self.files.write(f"{after + 1:012}.json", json.dumps(document))
        if self.keep:
            for n in [n for n in self.numbers() if n <= after + 1 - self.keep]:
                self.files.delete(f"{n:012}.json")
        return after + 1
