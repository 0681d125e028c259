"""URL rules answered by cascades of Bloom filters, with DataFrame functions only.

A rule is a host and a path: it fits the host and its subdomains where the url's path starts with the rule's. A url has
one key for each suffix of its host and each length of a listed path; a rule fits if its key is among them. Over the
keys of the whole corpus a cascade gives exact answers: level 1 holds the listed keys, level 2 the corpus's keys that
level 1 takes for listed, level 3 the listed keys that level 2 takes for those, and so on until none is left. The
lookup is an expression over one constant a level, so the urls meet no join. A cascade takes about
``listed * (1.44 * log2(corpus keys / listed) + 4)`` bits, so it is smaller than the list of rules that the caller holds,
however large the corpus is.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelens.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys by which a rule with a path of one of the ``lengths`` can fit."""
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths))]
    return F.filter(F.flatten(F.transform(suffixes, lambda s: F.array(*[F.concat(s, p) for p in starts]))), lambda k: k.isNotNull())


class Level:
    """A Bloom filter as 64-bit words, built from a frame of distinct keys."""

    def __init__(self, keys: DataFrame, count: int, rate: float, salt: int):
        self.hashes = max(1, math.ceil(-math.log2(rate)))
        self.words = max(1, math.ceil(count * self.hashes / math.log(2) / 64))
        self.salt = salt
        bits = keys.select(F.explode(F.array(*[self._place(F.col("key"), i) for i in range(self.hashes)])).alias("b"))
        word = bits.groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(b, 64) as int))")).alias("v"))
        found = {r["w"]: r["v"] for r in word.collect()}  # at most self.words rows, which follow the list
        self.values = ",".join(str(found.get(i, 0)) for i in range(self.words))

    def _place(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.salt * 64 + i)), F.lit(self.words * 64))

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(self.values), ",").cast("array<bigint>")  # folded into a constant when the query is planned

        def bit(i: int) -> Column:
            at = self._place(key, i)
            return F.getbit(F.get(words, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1

        return reduce(lambda a, b: a & b, [bit(i) for i in range(self.hashes)])


class Cascade:
    """Exact membership of the corpus's keys in a list."""

    def __init__(self, listed: DataFrame, corpus_keys: DataFrame, corpus_count: int, salt: int = 0):
        """``listed`` and ``corpus_keys`` have a column key; ``corpus_count`` is about the number of distinct corpus keys."""
        listed = listed.filter("key is not null").distinct()
        self.levels: list[Level] = []
        inside, n = listed, listed.count()
        outside, m = None, 0
        rate = min(0.5, math.sqrt(2) * n / max(1, corpus_count))
        while n:
            level = Level(inside, n, rate, salt * 1000 + len(self.levels))
            self.levels.append(level)
            if outside is None:
                outside = corpus_keys.filter(level.holds(F.col("key"))).select("key").distinct().join(listed, "key", "left_anti")
            else:
                outside = outside.filter(level.holds(F.col("key")))
            outside = written(outside, "level")
            inside, outside, n, m, rate = outside, inside, outside.count(), n, 0.5

    def holds(self, key: Column) -> Column:
        """Whether a key of the corpus is listed."""
        out = F.lit(False)
        for i in reversed(range(len(self.levels))):
            out = self.levels[i].holds(key) & (~out if i + 1 < len(self.levels) else F.lit(True))
        return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages`` (page_id, url; other columns are ignored).

    ``rules`` holds (verdict, rule) with rules like ``example.com/en/``; a rule needs a host and a path. The longest rule
    that fits gives the verdict (of equally long ones the first in text order), else ``default`` does and rule is null.
    Null urls and urls without ``://`` have empty host and path and fit no rule. Rows with null or repeated page_id stay
    as they are; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    if bad := [r for _, r in rules if not 0 < r.find("/")]:
        raise ValueError(f"rules need a host and a path: {bad}")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    lengths = [len(r) - r.index("/") for _, r in rules]
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = written(rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths)), "keys")
    corpus = keyed.select(F.explode("keys").alias("key"))
    count = corpus.agg(F.approx_count_distinct("key")).first()[0]
    hits = []
    for i, verdict in enumerate(sorted({v for v, _ in rules})):
        listed = spark.createDataFrame([(r,) for v, r in rules if v == verdict], "key string")
        cascade = Cascade(listed, corpus, count, i)
        found = F.filter("keys", cascade.holds)
        hits.append(F.transform(found, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("rule"), F.lit(verdict).alias("verdict"))))  # noqa: B023
    best = F.array_min(F.concat(*hits))
    return keyed.select("page_id", "host", "path", best.alias("best")).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
