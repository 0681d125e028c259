"""State over each key's rows in order: sorted within partitions and read one by one, with state of constant size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType
from pyspark.sql.window import Window


def stretches(picked: DataFrame, keys: list[str], time: str, gap: float) -> DataFrame:
    """Adds stretch to rows: the number of gaps of ``gap`` seconds and more that lie before a row among its key's times.

    Times are counted by key and slice of ``gap`` seconds first, combined before the shuffle, and a gap always lies between
    two slices; so a busy key is a row a slice where they are put in order. Rows without a time are in the first stretch.
    """
    slice_ = F.floor(F.col(time) / gap)
    counted = picked.groupBy(*keys, slice_.alias("slice")).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    own = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("slice"))
    opens = F.coalesce((F.col("lo") - F.lag("hi").over(own) >= gap).cast("int"), F.lit(0))
    numbered = counted.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    first = numbered.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("slice").alias("_slice"), "stretch")
    same = slice_.eqNullSafe(F.col("_slice"))
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    return picked.join(first, same).drop("_slice", *[f"_{k}" for k in keys])


def folded(rows: DataFrame, keys: list[str], order: list[Column], inputs: list[Column], start: tuple, step: Callable[..., tuple], name: str, kind: DataType, gap: float | None = None) -> DataFrame:
    """``rows`` with a column ``name``: what ``step(state, *inputs)`` gives, (state, value), of each row in its key's order.

    ``gap`` says after how many seconds between two rows, by ``order``'s first column, the state is as good as ``start``:
    then only the rows of a stretch without such a gap go through one task, as a stream, else all of a key. No row is joined
    back. Rows with a null key have a null value. A column of that name is replaced.
    """
    cols = [c for c in rows.columns if c.lower() != name.lower()]
    known = [F.col(f"`{k}`").isNotNull() for k in keys]
    test = known[0]
    for k in known[1:]:
        test &= k
    whole = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    picked = rows.filter(test).select(whole, *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], *[c.alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(f"i{i}") for i, c in enumerate(inputs)])
    by = [f"k{i}" for i in range(len(keys))]
    if gap is not None:
        picked = stretches(picked, by, "o0", gap)
        by = [*by, "stretch"]
    ordered = picked.repartition(*by).sortWithinPartitions(*by, *[f"o{i}" for i in range(len(order))]).select("row", *by, *[f"i{i}" for i in range(len(inputs))])
    n, m = len(by), len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start
        for batch in batches:
            out = []
            columns = [batch.column(1 + i).to_pylist() for i in range(n + m)]
            for x in zip(*columns, strict=True):
                if x[:n] != last:
                    last, state = x[:n], start
                state, value = step(state, *x[n:])
                out.append(value)
            yield pa.record_batch([batch.column(0), pa.array(out)], names=["row", name])

    found = ordered.mapInArrow(run, StructType([picked.schema["row"]]).add(name, kind)).select("row.*", f"`{name}`")
    return found.union(rows.filter(~test).select(*[F.col(f"`{c}`") for c in cols], F.lit(None).cast(kind).alias(name)))
