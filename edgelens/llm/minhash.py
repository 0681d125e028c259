"""Near-duplicate documents by bottom-k sketches of one hash function.

The sketch of a document is the k smallest hashes of its shingles. Documents with equal sets form a class at once.
Inverted lists of retained values give the pairs to look at, the sketch of the union estimates their similarity, and
the full sets decide. A pair of similarity t or more shares at least c of the values that the sketch of its union
retains, but for a chance of ``MISS``; so it shares one of the k - c + 1 rarest values of either sketch, and only those
are listed. Within a list every document
first meets the list's pivot alone. A list whose documents are then in one component is done: no further link could
change the result. What is left is grouped by pivot, and within a group all pairs of different components are compared,
small groups as rows, large ones in blocks, so that no rows are made for pairs that don't link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgelens.llm.common import byte_slices, drop, semi_join, sent, written
from edgelens.llm.components import connected_components
from edgelens.llm.shingles import shingle_sets

#: Chance that the sketches of a pair at the threshold share too few values.
MISS = 1e-7
#: Values in more than one of so many classes are ordered by their counts; there are at most SKETCH times this many.
HOT_SHARE = 20_000

#: Members of a group that are paired one by one; larger groups are compared in blocks of BLOCK.
FEW, BLOCK = 64, 256

#: Bytes of texts that are confirmed together.
PAIR_BYTES = 1 << 23

SIGNATURE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])


def fewest_shared(size: int, percent: int) -> int:
    """The largest c with P(Binomial(size, percent / 100) < c) <= MISS, 1 at least."""
    t, below = percent / 100, 0.0
    for c in range(size + 1):
        below += math.comb(size, c) * t**c * (1 - t) ** (size - c)
        if below > MISS:
            return max(1, c)
    return size


def listed(n: int, size: int, percent: int) -> int:
    """How many of the values of a sketch of a set of n are listed, so that no pair is lost (see fewest_shared)."""
    if n >= size:
        return size - fewest_shared(size, percent) + 1
    need = -(-percent * n // 100)  # of its n shingles, all of which it retains, so many are in any partner
    beyond = max(0, 100 * n // percent - size)  # and so many of them a partner's sketch may not retain
    return n - max(1, min(need - beyond, fewest_shared(size, percent) if beyond else need)) + 1


def signatures(docs: DataFrame, words: int, size: int) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the key of its text, the size and the key of its shingle set, and its sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column("text")):
                sets = shingle_sets(data, offsets, words)
                small = [s[:size] for s in sets]
                values = pa.array(np.concatenate(small))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in small])]).astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        batch.column("text_key").slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), values),
                    ],
                    names=SIGNATURE.names,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5("text")).alias("text_key")).mapInArrow(sign, SIGNATURE)


def _postings(classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(value, cid, n) of the rarest values of each class; n is the size of its set."""
    n = classes.count()
    floor = max(50, n // HOT_SHARE)
    rows = classes.select(F.explode("sketch").alias("value")).groupBy("value").count().filter(F.col("count") >= floor)
    found = rows.toArrow()  # at most n * size / floor <= size * HOT_SHARE rows, 20 MB
    hot = np.stack([found.column(c).to_numpy() for c in ("value", "count")], 1)
    hot = hot[np.argsort(hot[:, 0])]
    shared = classes.sparkSession.sparkContext.broadcast(hot)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            cids, sizes, sketches = batch.column("cid").to_numpy(), batch.column("n_shingles").to_numpy(), batch.column("sketch")
            values, ends = sketches.values.to_numpy(), sketches.offsets.to_numpy()
            counts = np.zeros(len(values), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known[:, 0], values), len(known) - 1)
                counts = np.where(known[at, 0] == values, known[at, 1], 0)
            out_v, out_c, out_n = [], [], []
            for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                take = np.lexsort((values[lo:hi], counts[lo:hi]))[: listed(int(sizes[i]), size, percent)]
                out_v.append(values[lo:hi][take])
                out_c.append(np.full(len(take), cids[i]))
                out_n.append(np.full(len(take), sizes[i]))
            if out_v:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (out_v, out_c, out_n)], names=["value", "cid", "n"])

    return classes.select("cid", "n_shingles", "sketch").mapInArrow(rarest, "value long, cid long, n long")


def _estimated(pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose union's sketch holds enough shared values."""
    classes = semi_join(classes, pairs.select(F.col("a").alias("cid")).union(pairs.select("b")), "cid")
    side = {x: classes.select(F.col("cid").alias(x), F.col("sketch").alias(f"s{x}"), F.col("text_key").alias(f"k{x}")) for x in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b")
    least = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, size)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), least))
    return both.filter(shared * size >= fewest_shared(size, percent) * F.size(least)).select("a", "b", "ka", "kb")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(4096, PAIR_BYTES // max(1, batch.nbytes // max(1, batch.num_rows))))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                texts = pa.chunked_array([part.column("ta"), part.column("tb")]).combine_chunks().dictionary_encode()  # a text that is in many pairs is cut into shingles once
                sets = [s for *_, data, ends in byte_slices(texts.dictionary) for s in shingle_sets(data, ends, words)]
                at = texts.indices.to_numpy()
                hits = []
                for x, y in zip(at[: part.num_rows].tolist(), at[part.num_rows :].tolist(), strict=True):
                    both = len(sets[x]) + len(sets[y])
                    inter = both - len(np.unique(np.concatenate([sets[x], sets[y]])))
                    hits.append(100 * inter >= percent * (both - inter))
                keep = pa.array(hits, pa.bool_())
                yield pa.record_batch([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    needed = pairs.select(F.col("ka").alias("text_key")).union(pairs.select("kb"))
    texts = semi_join(docs.select(F.unhex(F.md5("text")).alias("text_key"), "text"), needed, "text_key").groupBy("text_key").agg(F.first("text").alias("text"))
    # A pivot that many pairs hold is dealt to several tasks, FEW of its pairs each: its text goes there once a task.
    many = sent(written(pairs.groupBy("kb").count().filter(F.col("count") > FEW).select("kb", F.ceil(F.col("count") / FEW).alias("salts")), "pivots"))
    salts = F.coalesce("salts", F.lit(1))
    left = texts.select(F.col("text_key").alias("ka"), F.col("text").alias("ta"))
    right = texts.select(F.col("text_key").alias("kb"), F.col("text").alias("tb")).join(many, "kb", "left").select("kb", "tb", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    dealt = pairs.join(many, "kb", "left").withColumn("salt", F.pmod(F.xxhash64("ka"), salts)).drop("salts")
    return dealt.join(left, "ka").join(right, ["kb", "salt"]).select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long")


def _blocks(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each group (pivot, members, cid, component, text_key), from all its pairs.

    A group is cut into blocks of about BLOCK; a task compares the full sets of two blocks at a time, and gives only
    links between documents that its earlier links don't connect yet.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def links(part: list[tuple]) -> pa.RecordBatch:
            texts = pa.array([r[6] for r in part], pa.large_string())
            sets = [s for *_, data, ends in byte_slices(texts) for s in shingle_sets(data, ends, words)]
            side, cid, component = (np.array([r[i] for r in part]) for i in (3, 4, 5))
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            _, value, count = np.unique(flat, return_inverse=True, return_counts=True)
            shared = count[value] > 1
            value, owner = np.unique(value[shared], return_inverse=True)[1], owner[shared]
            one, two = (np.flatnonzero(side == x) for x in ((part[0][1], part[0][2]) if part[0][1] != part[0][2] else (part[0][1],) * 2))
            row = np.zeros(len(sets), np.int64)
            row[one], inter = np.arange(len(one)), np.zeros((len(one), len(two)), np.float32)
            other = np.zeros(len(sets), np.int64)
            other[two] = np.arange(len(two))
            in_one, in_two = np.isin(owner, one), np.isin(owner, two)
            for lo in range(0, int(value.max()) + 1 if len(value) else 0, 4096):
                here = (value >= lo) & (value < lo + 4096)
                x, y = np.zeros((len(one), 4096), np.float32), np.zeros((len(two), 4096), np.float32)
                x[row[owner[here & in_one]], value[here & in_one] - lo] = 1
                y[other[owner[here & in_two]], value[here & in_two] - lo] = 1
                inter += x @ y.T
            size = np.array([len(s) for s in sets])
            inter = inter.astype(np.int64)
            linked = 100 * inter >= percent * (size[one][:, None] + size[two][None, :] - inter)
            out = []
            while True:
                i, j = np.nonzero(linked & (component[one][:, None] != component[two][None, :]))
                if not len(i):
                    break
                a, b = one[i[0]], two[j[0]]
                out.append((max(cid[a], cid[b]), min(cid[a], cid[b])))
                component[component == component[b]] = component[a]
            cols = list(zip(*out, strict=True)) if out else [()] * 2
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("pivot", "i", "j", "block", "cid", "component", "text")], strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield links(held)
                    held = []
                held.append(row)
        if held:
            yield links(held)

    keys = members.select("text_key")
    texts = semi_join(docs.select(F.unhex(F.md5("text")).alias("text_key"), "text"), keys, "text_key").groupBy("text_key").agg(F.first("text").alias("text"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).join(texts, "text_key")
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("pivot", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "cid", "component", "text")
    return rows.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, size: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text; other columns are ignored).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. component_id is the smallest
    doc_id that is reachable, kept is doc_id = component_id. Null, empty and blank texts have no shingles and link with
    nothing. Rows may repeat: each gets its row, and rows of one doc_id that share a text are equal. A row with null
    doc_id takes part in links, never names a component of others, and is kept only where its component has no doc_id
    at all (component_id is null then). An empty table gives an empty table.
    """
    rows = written(signatures(docs, words, size), "signatures")
    classes = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("text_key").alias("text_key"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def near(x: str, y: str) -> Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    def new_links(pairs: DataFrame) -> DataFrame:
        candidates = written(pairs, "candidates")
        likely = written(_estimated(candidates, classes, size, percent), "pairs")
        drop(candidates)
        return _confirmed(likely, docs, words, percent)

    postings = _postings(classes, size, percent)
    lists = postings.groupBy("value").agg(F.count("*").alias("members"), F.min(F.struct("cid", "n")).alias("pivot")).filter("members > 1")
    members = written(postings.join(lists.select("value", "pivot.cid", "pivot.n").toDF("value", "pivot", "m"), "value").filter("cid != pivot"), "lists")
    links = written(new_links(members.filter(near("n", "m")).select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct()), "links")
    found = written(connected_components(links, "a", "b"), "components")

    labelled = members.select("value", "pivot", "cid", "n").join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = labelled.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("value")
    groups = written(labelled.join(mixed, "value", "left_semi").select("pivot", "cid", "n", "component").distinct(), "groups")
    drop(members)
    # Large groups are told by a small table of their pivots, so that no task is dealt a whole one by its pivot.
    large = sent(written(groups.groupBy("pivot").agg(F.count("*").alias("members")).filter(F.col("members") > FEW), "large"))
    few = groups.join(large, "pivot", "left_anti")
    other = few.select("pivot", F.col("cid").alias("other"), F.col("n").alias("m"), F.col("component").alias("own"))
    pairs = few.join(other, "pivot").filter((F.col("cid") < F.col("other")) & (F.col("component") != F.col("own")) & near("n", "m"))
    links = links.union(new_links(pairs.select(F.col("other").alias("a"), F.col("cid").alias("b")).distinct()))
    many = groups.join(large, "pivot").join(classes.select("cid", "text_key"), "cid")
    links = written(links.union(_blocks(written(many, "large groups"), docs, words, percent)), "links")
    found = written(connected_components(links, "a", "b"), "components")

    named = classes.select("set_key", "least", "cid").join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("set_key", "component_id")
    out = rows.filter("n_shingles > 0").join(named, "set_key").select("doc_id", "n_shingles", "component_id")
    out = out.union(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
