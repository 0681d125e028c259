"""What the operators share: written tables, text slices for numpy kernels, hashing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel works on at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


#: The folders (and ``table:`` names) that are taken inside ``gathered``.
_TAKEN: ContextVar[list[str] | None] = ContextVar("taken", default=None)
#: The folder of each written table.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def taken(place: str) -> str:
    """Notes a folder or ``table:`` name for the ``gathered`` block that stands around, if one does."""
    if (held := _TAKEN.get()) is not None:
        held.append(place)
    return place


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one the cluster names in spark.checkpoint.dir; a local one only where that is unset, on a local master."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="edgelens-")
        spark.sparkContext.setCheckpointDir(top)
    return taken(f"{top.rstrip('/')}/edgelens-{uuid.uuid4().hex}")


@contextlib.contextmanager
def gathered() -> Iterator[list[str]]:
    """A list of the shared folders and tables that are taken inside, for ``free`` once nothing reads them any more."""
    held: list[str] = []
    token = _TAKEN.set(held)
    try:
        yield held
    finally:
        _TAKEN.reset(token)


def free(spark: SparkSession, places: list[str]) -> None:
    """Deletes folders and tables of ``gathered`` (those that are gone already are passed over) and empties the list."""
    while places:
        place = places.pop()
        if place.startswith("table:"):
            spark.sql(f"drop table if exists {place.removeprefix('table:')}")
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators inside leave in the shared folder goes at the end; their results must have been written or collected by then."""
    with gathered() as held:
        try:
            yield
        finally:
            free(spark, held)


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        if folder := _FOLDERS.pop(t, None):
            free(t.sparkSession, [folder])


#: Rows that go to a Python worker at once, where rows hold texts: some MB.
TEXTS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is written; what is read later comes from the table. Texts meet Python in batches of TEXTS."""
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", TEXTS[0]: TEXTS[1]}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    with tidy(spark):
        df.write.parquet(f"{folder}/{name}")
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    _FOLDERS[out] = folder
    return out


#: Keys that semi_join may broadcast; with their overhead about 5 MB.
FEW_KEYS = 50_000


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` whose ``on`` is among ``keys`` (a written table): up to FEW_KEYS distinct ones are broadcast, more are shuffled."""
    return df.join(sent(written(keys.select(on).distinct(), "keys")), on, "left_semi")


def sent(keys: DataFrame) -> DataFrame:
    """A written table of short rows, to be joined: broadcast where it has FEW_KEYS rows at most."""
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of at most ``limit`` bytes, or of one longer row. Null counts as empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public domain splitmix64 constants)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """256 random odd 64-bit values, the same everywhere."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
