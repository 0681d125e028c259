"""Filter interaction audit: what filters remove alone, together and in every order, and their exact Shapley values.

A document that fails any filter of a coalition is removed by it, whatever the order. So one table of all coalitions'
removals by part answers everything: a step's counts are differences of two coalitions, and a filter's Shapley value is
the solution of a least-squares problem over all of them, which is solved in rationals.

Nulls: a null text counts as empty, a null part as an empty string. A document with a null id has no label, and neither
repeats another nor is repeated. A document that several label rows name has a mark if one of them gives it. Rows that
repeat an id count one by one. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The filters' letters; the bit of the i-th letter in a mask or coalition is 2**i.
FILTERS = "ABCDE"
REPEAT = FILTERS.index("E")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """The filters A to D that a text fails, as bits: few words, repeated words, upper case, marks."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, distinct, length = F.size(words), F.size(F.array_distinct(words)), F.length(text)
    upper = length - F.length(F.translate(text, UPPER, ""))
    tests = [n < 50, 100 * distinct < 65 * n, 100 * upper > 5 * length, text.rlike("[#$%&*|]")]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).cast("int")


def outcomes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (failed filters), n, good and toxic: how many documents of each part fail just those filters.

    Texts are read once; what is shuffled is a hash, an id and the mask. Copies of a text meet as counts by hash and part,
    combined before the shuffle, so a text that a third of the rows hold makes no large group.
    """
    text = F.coalesce("text", F.lit(""))
    each = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.md5(text)).alias("hash"), text_mask(text).alias("mask"))
    each = each.groupBy("doc_id", "part", "hash", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")])
    marked = each.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quality", "toxic")})
    alike = marked.groupBy("hash", "part", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("hash"))
    first_n = F.col("unnamed") + F.when(first, F.coalesce("n_least", F.lit(0))).otherwise(0)
    both = alike.withColumn("first_n", first_n).select(
        "part", "quality", "toxic",
        F.explode(F.array(F.struct("mask", F.col("first_n").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << REPEAT)).alias("mask"), (F.col("n") - F.col("first_n")).alias("n")))).alias("x"),
    )
    n = F.col("x.n")
    marked_n = [F.sum(F.when(F.col(c), n).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    return both.filter(n > 0).groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), *marked_n)


def coalitions(counted: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """part, coalition, total, removed, good, toxic: what each of the 2**n sets of filters removes of each part, zeros included."""
    each = counted.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    sums = [F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(name) for c, name in (("n", "removed"), ("good", "good"), ("toxic", "toxic"))]
    return each.groupBy("part", "coalition").agg(F.sum("n").alias("total"), *sums)


def shapley_weights(n: int) -> list[list[Fraction]]:
    """For each of n players the weight of each coalition's worth in its Shapley value.

    The values are those that minimize sum w(S) (v(S) - sum of S's values)**2 over all coalitions but the empty and the
    grand one, w(S) = (n-1) / (C(n,|S|) |S| (n-|S|)), and add up to the grand coalition's worth. The normal equations with
    a multiplier for that sum are the same for every worth, so they are solved once, for each coalition's unit worth.
    """
    if n == 1:
        return [[Fraction(0), Fraction(1)]]
    size = 1 << n
    kernel = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, size - 1)}
    rows = []
    for i in range(n):
        left = [sum((w for s, w in kernel.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)]
        rows.append([*left, Fraction(1), *[kernel.get(s, Fraction(0)) * (s >> i & 1) for s in range(size)]])
    rows.append([*[Fraction(1)] * n, Fraction(0), *[Fraction(int(s == size - 1)) for s in range(size)]])
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and (by := rows[r][c]):
                rows[r] = [x - by * y for x, y in zip(rows[r], rows[c], strict=True)]
    return [row[n + 1 :] for row in rows[:n]]


def audit(docs: DataFrame, labels: DataFrame, letters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of that step: a row for each part, each order of the filters and each step.

    kept: after the step; removed: here; redundant: failing the step's filter, removed before; unique_fails: failing that
    filter only; good_lost, toxic_lost: removed here with that label; shapley: the filter's removals over all orders.
    """
    return in_orders(coalitions(outcomes(docs, labels), len(letters)), letters)


def in_orders(tabulated: DataFrame, letters: str = FILTERS) -> DataFrame:
    """The rows of ``audit`` from a table of all coalitions: each part's table is one row of 2**n entries, then its orders follow."""
    n = len(letters)
    grand = (1 << n) - 1
    entries = F.array_sort(F.collect_list(F.struct("coalition", "removed", "good", "toxic")))
    whole = tabulated.groupBy("part").agg(F.max("total").alias("total"), entries.alias("v"))
    weights = [[x * factorial(n) for x in row] for row in shapley_weights(n)]
    assert all(x.denominator == 1 for row in weights for x in row)

    def shapley(row: list[Fraction]) -> Column:
        return sum((F.col("v")[s]["removed"] * F.lit(int(x)) for s, x in enumerate(row) if x), F.lit(0).cast("long"))

    def mask(prefix: Column) -> Column:
        return sum((F.when(F.contains(prefix, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))

    whole = whole.withColumn("values", F.array(*[shapley(row) for row in weights]))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    rows = whole.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    rows = rows.withColumns({"now": mask(F.substring("filter_order", F.lit(1), F.col("step"))), "own": mask(letter), "place": F.instr(F.lit(letters), letter)})
    rows = rows.withColumn("before", F.col("now") - F.col("own"))

    def at(coalition: Column, name: str) -> Column:
        return F.element_at("v", coalition + 1)[name]

    removed = at(F.col("now"), "removed") - at(F.col("before"), "removed")
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - at(F.col("now"), "removed")).alias("kept"), removed.alias("removed"),
        (at(F.col("own"), "removed") - removed).alias("redundant"), (at(F.lit(grand), "removed") - at(F.lit(grand) - F.col("own"), "removed")).alias("unique_fails"),
        (at(F.col("now"), "good") - at(F.col("before"), "good")).alias("good_lost"), (at(F.col("now"), "toxic") - at(F.col("before"), "toxic")).alias("toxic_lost"),
        F.element_at("values", F.col("place")).alias("shapley"),
    )
