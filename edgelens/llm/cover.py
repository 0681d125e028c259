"""Near-duplicate embeddings by dual traversal of cover trees.

Vectors of one label are scaled to length 1, where a cosine of c is a distance of sqrt(2 - 2c). A label's tree is grown
on Spark, level by level: a node with more than ``NODE`` vectors, or a small one wider than the threshold, takes some of
its own as centres, which lie more than half its radius apart; the vectors within half the radius of their nearest centre form the children, and what no centre
covers stays with the node's own centre for the next level. Nodes so tight that all their vectors link, and rests that
centres don't thin out, are cut by hash. The traversal starts with each label's root and itself; a pair of nodes whose
centres lie farther apart than their radii and the threshold allow is dropped, one that lies so close that all its
vectors link is taken whole, and any other is replaced by the pairs of its children. Leaves are dealt to bins of about
``NODE`` vectors, and the pairs of leaves of two bins go to one task together, which refines each leaf once into levels
with halving radii and goes on in the same way down to single vectors. So a vector goes to a task for each bin that holds
a leaf near its own: to few where vectors lie in clusters, and to one for each NODE vectors of its label, the half of them
on average, where they lie so evenly that no pair of leaves is far apart.

Links are not written out: of each vector only their number and a link that keeps it with its component are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgelens.llm.common import drop, written
from edgelens.llm.components import connected_components

#: Vectors of a leaf, about; children with fewer than a 32nd of it stay with the rest.
NODE = 1024
#: Vectors of a node that centres are picked from.
PIVOTS = 64
#: Vectors of a node that one task deals to its children.
DEAL = 1 << 16
#: A tree node in a task with so few vectors has them all as children.
LEAF = 8
#: Slack for rounding in distances.
ROUND = 1e-7


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class Tree:
    """A node of a cover tree: its centre is one of its vectors, its children's radii are at most half of its own."""

    __slots__ = ("centre", "children", "radius")

    def __init__(self, x: np.ndarray, members: np.ndarray):
        self.centre = int(members[0])
        far = _distances(x[members], x[[self.centre]])[:, 0]
        self.radius = float(far.max())
        self.children: list[Tree] = []
        if len(members) == 1:
            self.radius = 0.0
            return
        if len(members) <= LEAF or self.radius < ROUND:
            self.children = [Tree(x, members[i : i + 1]) for i in range(len(members))]
            return
        half = self.radius / 2
        while len(members):
            near = _distances(x[members], x[members[:1]])[:, 0] <= half
            near[0] = True
            self.children.append(Tree(x, members[near]))
            members = members[~near]


def pairs_within(x: np.ndarray, y: np.ndarray | None, reach: float, one: Tree | None = None, two: Tree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of unit vectors of x and y, or i < j of x alone, at most ``reach`` apart, by dual traversal of their trees."""
    other = x if y is None else y
    left, right = [], []
    one = one or Tree(x, np.arange(len(x)))
    todo = [(one, one if y is None else two or Tree(y, np.arange(len(y))))]
    while todo:
        a, b = todo.pop()
        ca, cb = a.children or [a], b.children or [b]
        ra, rb = (np.array([c.radius for c in cs]) for cs in (ca, cb))
        ia, ib = (np.array([c.centre for c in cs]) for cs in (ca, cb))
        p, q = np.nonzero(_distances(x[ia], other[ib]) <= ra[:, None] + rb[None, :] + reach)
        single = (ra[p] == 0) & (rb[q] == 0) & np.array([not ca[i].children and not cb[j].children for i, j in zip(p.tolist(), q.tolist(), strict=True)], bool)
        left.append(ia[p[single]])
        right.append(ib[q[single]])
        todo += [(ca[i], cb[j]) for i, j in zip(p[~single].tolist(), q[~single].tolist(), strict=True)]
    i, j = np.concatenate(left), np.concatenate(right)
    if y is None:  # a pair of nodes is met both ways round
        keep = i < j
        i, j = i[keep], j[keep]
    return i, j


def net(x: np.ndarray, half: float) -> list[int]:
    """Places of vectors that lie more than ``half`` apart, and within it of all others; earlier ones first."""
    far, out = _distances(x, x), []
    for i in range(len(x)):
        if not out or far[i, out].min() > half:
            out.append(i)
    return out


def least_of_group(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n places the least one that it is connected with by links (i, j)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            return low


CLASSES = "part struct<label: string, d: int>, embedding array<double>, copies long, least long, cid long, u array<double>"


def _classes(vectors: DataFrame) -> DataFrame:
    """One row for each different vector of a label: part (label and dimension), embedding, copies, least vec_id, cid and u (of length 1)."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes, lists = np.diff(column.offsets.to_numpy()), [None] * len(column)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                for i, v in zip(at.tolist(), _unit(_matrix(column.take(pa.array(at)))), strict=True):
                    lists[i] = v
            yield pa.record_batch([*batch.columns, pa.array(lists, pa.list_(pa.float64()))], names=[*batch.schema.names, "u"])

    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.filter(F.col("label").isNotNull() & F.coalesce(good, F.lit(False))).select("vec_id", F.struct(F.col("label").cast("string").alias("label"), F.size("embedding").alias("d")).alias("part"), x.alias("embedding"))
    rows = rows.groupBy("part", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    return written(rows.withColumn("cid", F.monotonically_increasing_id()).mapInArrow(unit, CLASSES), "vectors")


def _spread(cid: str = "cid") -> Column:
    return F.xxhash64(cid, F.lit(7))


MEMBERS = "node long, radius double, size long, cid long, copies long, u array<double>, path array<long>"


def _dealt(active: DataFrame, reach: float) -> DataFrame:
    """The vectors of large nodes with i, the centre that covers them (-1: none but the node's own), and their distance to it and to the node's own."""
    order = Window.partitionBy("node").orderBy(_spread(), "cid")
    loose = F.col("radius") * 2 + ROUND > reach
    picked = active.filter(loose).select("node", "radius", "cid", "u", F.row_number().over(order).alias("i")).filter(F.col("i") <= PIVOTS)
    groups = picked.groupBy("node", "radius").agg(F.array_sort(F.collect_list(F.struct("i", "u"))).alias("picked"))  # at most PIVOTS a node

    def nets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, radius, some in zip(*[batch.column(c).to_pylist() for c in ("node", "radius", "picked")], strict=True):
                x = np.array([s["u"] for s in some])
                at = net(x, radius / 2)
                yield pa.record_batch([pa.array([node] * len(at)), pa.array(at, pa.int32()), pa.array(list(x[at]), pa.list_(pa.float64()))], names=["node", "i", "u"])

    nodes = active.groupBy("node").agg(F.first("radius").alias("radius"), F.first("size").alias("size"), F.first("centre").alias("u"))
    salts = F.ceil(F.col("size") / DEAL).cast("int")
    own = nodes.select("node", F.lit(-1).alias("i"), "u")
    centres = groups.mapInArrow(nets, "node long, i int, u array<double>").union(own)
    # A node's centres go along to each task that deals its vectors, ahead of them, and once only.
    centres = centres.join(nodes.select("node", "radius", salts.alias("salts")), "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    none = F.lit(None)
    ahead = centres.select("node", "salt", F.lit(0).alias("kind"), "i", "radius", "u", none.cast("long").alias("cid"), none.cast("long").alias("copies"), none.cast("array<long>").alias("path"))
    rows = active.select("node", F.pmod(_spread(), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), none.cast("int").alias("i"), "radius", "u", "cid", "copies", "path")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre, number = None, [], []
        for batch in batches:
            node, salt, kind = (batch.column(c).to_numpy() for c in ("node", "salt", "kind"))
            edge = np.ones(batch.num_rows + 1, bool)
            edge[1:-1] = (node[1:] != node[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])
            edge = np.flatnonzero(edge).tolist()
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if (node[a], salt[a]) != key:
                    key, centre, number = (node[a], salt[a]), [], []
                part = batch.slice(a, b - a)
                if not kind[a]:
                    centre.append(_matrix(part.column("u")))
                    number.append(part.column("i").to_numpy())
                    continue
                c, i = np.concatenate(centre), np.concatenate(number)
                far = _distances(_matrix(part.column("u")), c)
                home, others = far[:, i < 0][:, 0], far[:, i >= 0]
                near = others.min(1) if others.shape[1] else np.full(b - a, np.inf)
                took = near <= part.column("radius").to_numpy() / 2
                to = np.where(took, i[i >= 0][others.argmin(1)] if others.shape[1] else -1, -1)
                columns = [part.column(x) for x in ("node", "cid", "copies", "u", "path")]
                yield pa.record_batch([*columns, pa.array(to.astype(np.int32)), pa.array(np.where(took, near, home)), pa.array(home)], names=["node", "cid", "copies", "u", "path", "i", "far", "home"])

    both = ahead.unionByName(rows).repartition("node", "salt").sortWithinPartitions("node", "salt", "kind", "i")
    dealt = both.mapInArrow(deal, "node long, cid long, copies long, u array<double>, path array<long>, i int, far double, home double")
    return written(dealt, "dealt"), written(centres.select("node", "i", F.col("u").alias("centre")).distinct(), "centres")


def _level(active: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """(vectors, nodes) of the children of large nodes."""
    dealt, centres = _dealt(active, reach)
    large = dealt.filter("i >= 0").groupBy("node", "i").count().filter(F.col("count") >= max(2, NODE // 32)).select("node", "i", F.lit(True).alias("own"))
    rows = dealt.join(large, ["node", "i"], "left")
    rows = rows.withColumn("far", F.when(F.col("own"), F.col("far")).otherwise(F.col("home"))).withColumn("i", F.when(F.col("own"), F.col("i")).otherwise(-1))
    rows = written(rows.select("node", "i", "cid", "copies", "u", "path", "far"), "children")
    sizes = rows.groupBy("node").agg(F.count("*").alias("all"), F.count_if(F.col("i") < 0).alias("rest"))
    cut = (F.col("i") < 0) & (F.col("rest") > NODE) & (2 * F.col("rest") > F.col("all"))  # centres that cover less than half won't help
    rows = rows.join(sizes.filter(F.col("rest") > NODE), "node", "left").withColumn("chunks", F.when(cut, F.ceil(F.col("rest") / NODE)).otherwise(1))
    rows = rows.withColumn("child", F.xxhash64("node", "i", F.pmod(_spread(), "chunks"))).withColumn("cut", F.col("chunks") > 1)
    rows = written(rows.select(F.col("node").alias("parent"), "child", "i", "cut", "cid", "copies", "u", "path", "far"), "members")
    nodes = rows.groupBy("child", "parent", "i").agg(F.max("far").alias("radius"), F.count("*").alias("size"), F.sum("copies").alias("copies"), F.min("cid").alias("least"), F.first("cut").alias("cut"))
    nodes = nodes.join(centres.withColumnRenamed("node", "parent"), ["parent", "i"])
    # A node within reach of its centre, or what centres left over, is a leaf once it is small; a wide one goes on as long as children can be made.
    tight = (F.col("i") < 0) | (F.col("radius") <= reach) | (F.col("size") < 2 * max(2, NODE // 32))
    leaf = F.col("cut") | ((F.col("size") <= NODE) & tight)
    nodes = written(nodes.select(F.col("child").alias("node"), "parent", "centre", "radius", "size", "copies", "least", leaf.alias("leaf")), "nodes")
    path = F.array_append("path", F.col("child"))
    made = rows.select(F.col("child").alias("node"), "cid", F.col("copies").alias("n"), "u", path.alias("path"))
    made = written(made.join(nodes.select("node", "radius", "size", "leaf", "centre"), "node").withColumnRenamed("n", "copies"), "vectors")
    drop(dealt, centres, rows)
    return made, nodes


def grown(classes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """(vectors with their leaf and the path of nodes that leads there, nodes of all levels)."""
    root = F.xxhash64("part.label", "part.d")
    roots = classes.groupBy(root.alias("node")).agg(F.min_by("u", F.struct(_spread(), F.col("cid"))).alias("centre"), F.count("*").alias("size"), F.sum("copies").alias("copies"), F.min("cid").alias("least"))
    roots = roots.select("node", F.lit(None).cast("long").alias("parent"), "centre", F.lit(2.0).alias("radius"), "size", "copies", "least", (F.col("size") <= NODE).alias("leaf"))
    nodes = written(roots, "roots")
    vectors = classes.select(root.alias("node"), "cid", "copies", "u", F.array(root).alias("path"))
    active = written(vectors.join(nodes.select("node", "radius", "size", "leaf", "centre"), "node"), "vectors")
    leaves = []
    while True:
        leaves.append(active.filter("leaf").select("node", "cid", "copies", "u", "path"))
        rest = active.filter("not leaf")
        if rest.isEmpty():
            break
        active, more = _level(rest, reach)
        nodes = nodes.union(more)
    out = leaves[0]
    for more in leaves[1:]:
        out = out.union(more)
    return out, nodes


def traversed(nodes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """(pairs of leaves that may hold links, pairs of nodes all of whose vectors link), na <= nb."""
    nodes = written(nodes, "tree")
    side = {x: nodes.select(F.col("node").alias(f"n{x}"), F.col("centre").alias(f"c{x}"), F.col("radius").alias(f"r{x}"), F.col("leaf").alias(f"leaf{x}")) for x in "ab"}
    kids = {x: nodes.filter("parent is not null").select(F.col("parent").alias(f"n{x}"), F.col("node").alias(f"k{x}")) for x in "ab"}
    square = F.aggregate(F.zip_with("ca", "cb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    apart = F.when(F.col("na") == F.col("nb"), 0.0).otherwise(F.sqrt(square))
    pairs = nodes.filter("parent is null").select(F.col("node").alias("na"), F.col("node").alias("nb"))
    near, whole = [], []
    while True:
        known = pairs.join(side["a"], "na").join(side["b"], "nb").withColumn("apart", apart)
        known = known.filter(F.col("apart") <= F.col("ra") + F.col("rb") + reach + ROUND)
        inside = F.col("apart") + F.col("ra") + F.col("rb") <= reach - 2 * ROUND
        known = written(known.select("na", "nb", "leafa", "leafb", inside.alias("inside")), "node pairs")
        whole.append(known.filter("inside").select("na", "nb"))
        near.append(known.filter("not inside and leafa and leafb").select("na", "nb"))
        todo = known.filter("not inside and not (leafa and leafb)").select("na", "nb")
        if todo.isEmpty():
            break
        todo = todo.join(kids["a"], "na", "left").join(kids["b"], "nb", "left").select("na", "nb", F.coalesce("ka", "na").alias("x"), F.coalesce("kb", "nb").alias("y"))
        # The children of a node and itself are met both ways round; a leaf has no children and stands for itself.
        pairs = todo.filter((F.col("na") != F.col("nb")) | (F.col("x") <= F.col("y"))).select(F.least("x", "y").alias("na"), F.greatest("x", "y").alias("nb"))
    for more in near[1:]:
        near[0] = near[0].union(more)
    for more in whole[1:]:
        whole[0] = whole[0].union(more)
    return near[0], whole[0]


def _shipped(near: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vectors that each pair of bins (one, two) needs, with their leaf and the leaves that it is to be compared with there."""
    # Leaves in the tree's order, so that a bin holds neighbours.
    leaves = vectors.groupBy("node").agg(F.first("path").alias("path"), F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy(F.col("path")[0]).orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    bins = written(leaves.select("node", F.xxhash64(F.col("path")[0], F.floor(F.coalesce(before, F.lit(0)) / NODE)).alias("bin")), "bins")
    pairs = near.join(bins.toDF("na", "x"), "na").join(bins.toDF("nb", "y"), "nb").select("na", "nb", F.least("x", "y").alias("one"), F.greatest("x", "y").alias("two"))
    none = F.lit(None).cast("long")
    sides = pairs.select("one", "two", F.col("na").alias("node"), F.col("nb").alias("partner")).union(pairs.filter("na != nb").select("one", "two", "nb", none))
    sides = sides.groupBy("one", "two", "node").agg(F.collect_list("partner").alias("partners"))  # at most a bin's leaves
    return sides.join(vectors.select("node", "cid", "copies", "u"), "node")


def links(classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """((cid, others) with the rows of other classes that each class links with, (a, b) links that join the components)."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + ROUND
    vectors, nodes = grown(classes, reach)
    near, whole = traversed(nodes, reach)

    def compare(group: pa.Table) -> pa.Table:
        own, cid, copies = (group.column(c).to_numpy() for c in ("node", "cid", "copies"))
        order = np.lexsort((cid, own))
        partners = group.column("partners").take(pa.array(order))
        own, cid, copies, u = own[order], cid[order], copies[order], _matrix(group.column("u"))[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        spans = {int(own[f]): (int(f), int(t)) for f, t in zip(first, [*first[1:], len(own)], strict=True)}
        trees = {k: Tree(u[f:t], np.arange(t - f)) for k, (f, t) in spans.items()}
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (f, t) in spans.items():
            for other in partners[f].as_py():
                g, h = spans[other]
                i, j = pairs_within(u[f:t], None if other == k else u[g:h], reach, trees[k], trees[other])
                left.append(i + f)
                right.append(j + g)
        i, j = np.concatenate(left), np.concatenate(right)
        hit = (u[i] * u[j]).sum(1) >= cosine
        i, j = i[hit], j[hit]
        n = np.bincount(i, copies[j], len(cid)) + np.bincount(j, copies[i], len(cid))
        rank = np.argsort(np.argsort(cid))  # components are named by the least cid
        low = np.sort(cid)[least_of_group(len(cid), rank[i], rank[j])][rank]
        some = n > 0
        return pa.table({"cid": cid[some], "others": n[some].astype(np.int64), "to": low[some]})

    found = _shipped(near, vectors).groupBy("one", "two").applyInArrow(compare, "cid long, others long, to long")
    # Of nodes that link as a whole: a vector links with all of the other node, so with that node's first vector too.
    size = nodes.select("node", F.col("copies").alias("all"), "least")
    ends = whole.select("na", "nb").union(whole.filter("na != nb").select(F.col("nb"), F.col("na"))).toDF("node", "other")
    joined = ends.join(size.toDF("other", "more", "first"), "other").join(size.select("node", F.col("least").alias("own")), "node")
    joined = written(joined, "whole")
    sums = joined.groupBy("node").agg(F.sum("more").alias("more"), F.max(F.col("node") == F.col("other")).alias("self"), F.first("own").alias("own"))
    under = vectors.select("cid", "copies", F.explode("path").alias("node")).join(sums, "node")
    under = under.select("cid", (F.col("more") - F.when(F.col("self"), F.col("copies")).otherwise(0)).alias("others"), F.col("own").alias("to"))
    both = written(found.union(under), "links")
    counts = both.groupBy("cid").agg(F.sum("others").alias("others"))
    edges = both.select(F.col("cid").alias("a"), F.col("to").alias("b")).union(joined.select(F.col("own").alias("a"), F.col("first").alias("b")))
    return counts, edges.filter("a != b").distinct()


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding, label; other columns are ignored).

    Rows link if their labels are equal and not null and the cosine of their embeddings, in double precision, is
    ``cosine`` or more. n_links counts the other rows that a row links with directly; component_id is the smallest vec_id
    reachable, itself included, and kept is vec_id = component_id. Embeddings that are null, empty or zero, or hold null
    or non-finite components, and embeddings of different dimensions, link with nothing. Rows may repeat: they are rows
    apart, and link. A null vec_id never names a component of others. An empty table gives an empty table.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    classes = _classes(rows)
    sums, found = links(classes, cosine)
    sums = written(sums, "counts")
    parts = connected_components(found, "a", "b").withColumnRenamed("id", "cid")
    named = classes.select("part", "embedding", "cid", "copies", "least").join(sums, "cid", "left").join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("part", F.col("embedding").alias("x"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    keyed = rows.select("vec_id", F.when(F.col("label").isNotNull(), F.struct(F.col("label").cast("string").alias("label"), F.size("embedding").alias("d"))).alias("part"), F.col("embedding").cast("array<double>").alias("x"))
    out = keyed.join(named, ["part", "x"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
