"""Secret scanning over a ledger of content-addressed blobs, with DataFrame functions only.

Each version of a text is a blob named by the SHA-256 of its UTF-8 bytes. The ledger, a Parquet table, says which pairs
of blob and rule version were scanned and what was found. A scan hashes all versions, drops the pairs that the ledger
has, scans each remaining blob once, appends, and joins the findings back to every path that holds the blob.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelens.llm.common import FEW_KEYS, drop, shared_dir, tidy, written


@dataclass(frozen=True)
class Rule:
    """A Java pattern; a match counts if its group ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


# The patterns to be found, in their order.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)

LEDGER = "blob string, `order` int, kind string, version int, spans array<struct<start:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """An array cut into about as many arrays as each has items: folds over it copy little, however long it is."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / width).cast("int"))
    return _let(width, lambda w: F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * w + 1, w)))


def _starts(blocks: Column, later: Callable[[Column, Column], Column]) -> Column:
    """Where each block begins, and the end: ``later`` gives it from the one before and its block."""
    return F.aggregate(blocks, F.array(F.lit(0)), lambda at, b: F.array_append(at, later(F.element_at(at, -1), b)))


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's leftmost non-overlapping matches, in code points, end exclusive.

    The text is cut into pairs of gap and match, and a last rest that holds none; starts are sums of lengths.
    """
    cut = f"(?s)(.*?)({rule.pattern})|.+"
    gaps, hits = F.regexp_extract_all(text, F.lit(cut), F.lit(1)), F.regexp_extract_all(text, F.lit(cut), F.lit(2))
    kept = F.regexp_extract_all(text, F.lit(cut), F.lit(2 + rule.group)) if rule.group else hits
    found = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), kept.alias("kept")), lambda p: p["hit"] != "")
    parts = F.transform(found, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("hit"), F.length(p["kept"]).alias("n")))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + p["gap"]
        end = begin + p["hit"]
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), p["n"].alias("n")))).alias("spans"))

    def of_block(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int,n:int>>").alias("spans"))
        return F.aggregate(block, start, step)["spans"]

    def whole(blocks: Column) -> Column:
        starts = _starts(blocks, lambda at, b: at + F.aggregate(b, F.lit(0), lambda s, p: s + p["gap"] + p["hit"]))
        return _let(starts, lambda at: F.flatten(F.transform(blocks, lambda b, i: of_block(b, at[i]))))

    spans = F.filter(_let(parts, lambda p: _let(_blocks(p), whole)), lambda s: s["n"] >= rule.least)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(text.rlike(rule.pattern), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(none)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


#: Characters from which a text counts as one that was added to.
GROWN = 4000


def earlier(text: Column) -> Column:
    """What a text was before its last change: its first half where it has GROWN characters or more, else what it is now."""
    return F.when(F.length(text) >= GROWN, F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))).otherwise(text)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks, and return the ledger's findings: blob, order, kind, version, spans, one row a pair.

    ``versions`` has a column text (null counts as empty), one row for each version of each path. ``ledger`` is a folder
    of Parquet files that this call may create and appends to. Scanning the same versions again moves their hashes only.
    Pairs that are in the ledger twice (of scans at one time, or an append that was tried again) count once.
    """
    spark = versions.sparkSession
    rows = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    known, unseen = _ledger(spark, ledger), None
    if known is None:
        blobs = rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", wanted)
    else:
        done = known.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))
        todo = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
        unseen = rows.select("blob").distinct().join(done, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)
        unseen = written(unseen, "unseen")  # hashes only: texts move just for these
        if unseen.count() <= FEW_KEYS:
            blobs = rows.join(F.broadcast(unseen), "blob").groupBy("blob", "todo").agg(F.first("text").alias("text"))
        else:
            blobs = rows.groupBy("blob").agg(F.first("text").alias("text")).join(unseen, "blob")
    found = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), matches(F.col("text"), r)).alias("spans")) for i, r in enumerate(rules)])
    new = blobs.select("blob", F.explode(found).alias("f")).select("blob", "f.*").filter("spans is not null")
    with tidy(spark):
        new.write.mode("append").parquet(ledger)
    if unseen is not None:
        drop(unseen)
    return _found(_ledger(spark, ledger), rules).dropDuplicates(["blob", "kind", "version"])


def _ledger(spark, path: str) -> DataFrame | None:
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def _found(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger's rows of these rules, numbered by their order here."""
    places = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (f"{r.kind}:{r.version}", i)])
    place = places[F.concat_ws(":", "kind", "version")]
    return ledger.withColumn("order", place).filter(F.col("order").isNotNull())


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """The rows of ``docs`` (text; other columns stay) with ``findings``: array<struct<start, order, end, kind>> by start, then rule order.

    Null and empty texts have no findings. Equal texts are scanned once. Without a ``ledger`` an empty one in the shared
    folder is used. An empty table gives an empty table. A column named findings is replaced; other names never clash.
    """
    ledger = ledger or f"{shared_dir(docs.sparkSession)}/ledger"
    scan(docs, ledger, rules)
    spans = _found(_ledger(docs.sparkSession, ledger), rules).filter(F.size("spans") > 0)
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("order").alias("order"), s["end"].alias("end"), F.col("kind").alias("kind")))
    found = spans.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set(each))).alias("found"))  # a set: repeated ledger rows count once
    # The row's own columns stay apart in a struct, so that none clashes with the names used here.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, blob_id(F.col("text")).alias("blob")).join(found, "blob", "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() != "findings"], F.coalesce("found", none).alias("findings"))


def redact(docs: DataFrame, mask: str = "[secret]", rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by ``mask``; overlapping spans are replaced as one.

    Null texts stay null; all other columns, whatever their names, stay as they are.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = find_secrets(docs.select(whole, "text"), rules, ledger)

    def of_block(block: Column, part: Column, base: Column) -> Column:
        """What becomes of a part of the text that begins at ``base`` and ends with its last span."""
        start = F.struct(base.alias("at"), F.lit("").alias("out"))

        def step(state: Column, s: Column) -> Column:
            fresh = s["start"] >= state["at"]
            gap = F.when(fresh, F.concat(F.substring(part, state["at"] - base + 1, s["start"] - state["at"]), F.lit(mask))).otherwise(F.lit(""))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

        return F.aggregate(block, start, step)["out"]

    def masked(blocks: Column) -> Column:
        ends = _starts(blocks, lambda at, b: F.greatest(at, F.array_max(F.transform(b, lambda s: s["end"]))))

        def joined(at: Column) -> Column:
            done = F.transform(blocks, lambda b, i: _let(F.substring(F.col("text"), at[i] + 1, at[i + 1] - at[i]), lambda part: of_block(b, part, at[i])))
            return F.concat(F.array_join(done, ""), F.substring(F.col("text"), F.element_at(at, -1) + 1, F.length("text")))

        return _let(ends, joined)

    text = F.when(F.size("findings") == 0, F.col("text")).otherwise(_let(F.col("findings"), lambda f: _let(_blocks(f), masked)))
    done = rows.select("row", text.alias("masked"))
    return done.select(*[(F.col("masked") if c.lower() == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
