"""Exact top-k inner products by descending length with partial sums.

Vectors and queries are turned by the right singular vectors of the queries, which keeps inner products and gathers
their weight in the first components. Each task takes its vectors by descending length. By Cauchy-Schwarz a query's
score is at most the product of lengths, so a query is done with a task once that falls below its k-th score; and at
most the partial sum over the first components and the product of the residual lengths, which spares most of the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgelens.llm.common import drop, shared_dir, tidy, written

#: Queries that go along with one pass over the vectors.
QUERY_BLOCK = 8192
#: Vectors that are scored at once.
VECTOR_BLOCK = 512
#: Share of the components in the partial sums.
PART = 4
#: Relative slack for rounding in the bounds.
ROUND = 1e-9

RESULT = "query_id long, rank int, vec_id long, score long"

_NONE = np.iinfo(np.int64).min


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def turn(vectors: np.ndarray) -> np.ndarray:
    """The right singular vectors of a matrix, largest first, as columns: the eigenvectors of its small Gram matrix."""
    real = vectors.astype(np.float64)
    return np.ascontiguousarray(np.linalg.eigh(real.T @ real)[1][:, ::-1])


class Best:
    """The ``size`` best (score, vec_id) so far of each query of a block, its own row among them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, turned_by: np.ndarray, size: int):
        self.ids, self.vectors, self.size, self.turn = ids, vectors, size, turned_by
        self.score = np.full((len(ids), size), _NONE, np.int64)
        self.vec = np.full((len(ids), size), np.iinfo(np.int64).max, np.int64)
        self.real = vectors.astype(np.float64)
        self.turned = self.real @ self.turn
        self.part = max(1, vectors.shape[1] // PART)
        self.length = np.sqrt((self.real**2).sum(1))
        self.rest = np.sqrt((self.turned[:, self.part :] ** 2).sum(1))

    def take(self, vec_id: np.ndarray, x: np.ndarray) -> None:
        """Vectors, best with lengths in descending order."""
        real = x.astype(np.float64)
        length = np.sqrt((real**2).sum(1))
        floor = self.score[:, -1].astype(np.float64)
        active = np.flatnonzero(self.length * length.max() * (1 + ROUND) >= floor)
        if not len(active):
            return
        turned = real @ self.turn
        rest = np.sqrt((turned[:, self.part :] ** 2).sum(1))
        high = self.turned[active, : self.part] @ turned[:, : self.part].T + self.rest[active, None] * rest
        slack = ROUND * (self.length[active, None] * length)
        open_ = high + slack >= floor[active, None]
        rows = open_.any(1)
        active, open_ = active[rows], open_[rows]
        if not len(active):
            return
        cols = np.flatnonzero(open_.any(0))
        open_ = open_[:, cols]
        if self.length.max() * length.max() < 2**52:  # all sums are whole numbers that doubles hold
            score = (self.real[active] @ real[cols].T).astype(np.int64)
        else:
            score = self.vectors[active] @ x[cols].T
        score[~open_] = _NONE
        score = np.concatenate([self.score[active], score], 1)
        ids = np.concatenate([self.vec[active], np.where(open_, vec_id[cols][None, :], np.iinfo(np.int64).max)], 1)
        order = np.lexsort((ids, ~score), axis=1)[:, : self.size]  # ~ turns the order round and can't overflow
        self.score[active] = np.take_along_axis(score, order, 1)
        self.vec[active] = np.take_along_axis(ids, order, 1)

    def own(self) -> np.ndarray:
        """Which of the best could be the query's own row: its vec_id, and the score of its vector with itself."""
        return (self.vec == self.ids[:, None]) & (self.score == (self.vectors * self.vectors).sum(1)[:, None])


def search(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query.

    ``vectors`` has vec_id and embedding; other columns are ignored. Components become floor(scale * component); the
    score is the integer inner product, exact while it is below 2**63. Queries are the rows whose vec_id is divisible by
    ``every``, candidates all rows but the query's own; ties go to the smaller vec_id. Rows with null vec_id, and
    embeddings that are null, empty or hold null or non-finite components, take no part; a query meets vectors of its own
    dimension. Repeated rows are candidates and queries apart. An empty table gives an empty table. Queries go in blocks
    of about QUERY_BLOCK, one pass over the vectors for each; the plan of a pass is the same for any number of blocks.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("x"))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "x").agg(F.count("*").alias("copies"))
    length = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    ordered = rows.sortWithinPartitions(F.desc(length)).select("vec_id", "x")
    blocks = -(-asked.count() // QUERY_BLOCK)
    if not blocks:
        return spark.createDataFrame([], RESULT)
    if blocks == 1:
        return _ranked(_pass(ordered, asked.toArrow(), k + 1), k)
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks))), "queries")
    ordered, path = written(ordered, "ordered"), f"{shared_dir(spark)}/found"
    for i in range(blocks):
        block = asked.filter(F.col("block") == i).drop("block").toArrow()  # about QUERY_BLOCK rows
        with tidy(spark):
            _ranked(_pass(ordered, block, k + 1), k).write.mode("append").parquet(path)
    drop(asked, ordered)
    return spark.read.schema(RESULT).parquet(path)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, without one row that is its own, as often as the query is there."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    first = found.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k + 1)
    met = F.sum(F.col("own").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = first.withColumn("met", met).filter(~(F.col("own") & (F.col("met") == 1)))
    ranked = first.withColumn("rank", (F.col("i") - F.least("met", F.lit(1))).cast("int")).filter(F.col("rank") <= k)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", "score")


def _pass(ordered: DataFrame, block: pa.Table, size: int) -> DataFrame:
    """The ``size`` best of each task for each query of a block (vec_id, x, copies)."""
    by_size: dict[int, tuple[np.ndarray, ...]] = {}
    ids, copies, lists = block.column("vec_id").to_numpy(), block.column("copies").to_numpy(), block.column("x").combine_chunks()
    if len(ids):
        sizes = np.diff(lists.offsets.to_numpy())
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            own = _matrix(lists.take(pa.array(at)))
            by_size[d] = (at, ids[at], copies[at], own, turn(own))
    shared = ordered.sparkSession.sparkContext.broadcast(by_size)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {d: Best(i, v, t, size) for d, (_, i, _, v, t) in shared.value.items()}
        for batch in batches:
            column, vec_id = batch.column("x"), batch.column("vec_id").to_numpy()
            sizes = np.diff(column.offsets.to_numpy())
            for d, b in held.items():
                at = np.flatnonzero(sizes == d)
                for lo in range(0, len(at), VECTOR_BLOCK):
                    part = at[lo : lo + VECTOR_BLOCK]
                    b.take(vec_id[part], _matrix(column.take(pa.array(part))))
        for d, b in held.items():
            i, j = np.nonzero(b.score != _NONE)
            at, _, copies, _, _ = shared.value[d]
            columns = [at[i].astype(np.int64), b.ids[i], copies[i].astype(np.int64), b.vec[i, j], b.score[i, j], b.own()[i, j]]
            yield pa.record_batch([pa.array(c) for c in columns], names=["query", "query_id", "copies", "vec_id", "score", "own"])

    return ordered.mapInArrow(best, "query long, query_id long, copies long, vec_id long, score long, own boolean")
