"""Removal of every byte that a repeated string covers, by sorting suffixes deep-shallow.

A string of ``length`` bytes that occurs twice has the same least gram (an anchor) at the same place in both. So only
suffixes whose strings share an anchor are ever compared. Each maximal run of string starts with one anchor makes a
segment; segments with equal bytes are repeats as a whole, and need no sorting. Of anchors with several different
segments one copy of each segment is gathered, and the suffixes at its string starts are sorted: by multikey passes
over eight bytes at a time to a shallow depth, then, what still hangs together, by blind tries, which compare a suffix
with one leaf and hang it off where the two part. Suffixes that reach ``length`` together are repeats.

Strings are counted in bytes or in words. A word is sorted as a code of eight bytes, and suffixes begin with words then.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgelens.llm.common import byte_slices, byte_table, drop, mix, shared_dir, taken, tidy, written


class Unit(NamedTuple):
    """What strings are counted in."""

    #: Bytes of a unit where it is sorted.
    size: int
    #: Units of an anchor gram; a power of two.
    gram: int
    #: String starts in a block of an anchor with more than MANY segments; no string is shorter.
    block: int


BYTES = Unit(1, 32, 64)
#: Words are what lies between white space.
WORDS = Unit(8, 8, 8)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes that the multikey passes look at.
SHALLOW = 64
#: Anchors with more different segments are dealt by block and core, see _dealt.
MANY = 512
#: Blocks of one anchor and core with more segments have their strings counted by hash, see _counted_repeats.
HOT = 2048
#: Bytes of segments that are sorted together.
SORT_BYTES = 1 << 20


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(64-bit code of each word, its first byte, the byte after it, offsets of the texts in words) of a slice of texts."""
    solid = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - begin
    ahead = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(ahead, size)
    # A sum of a random value for each byte at its place in the word.
    value = mix(data[solid].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(0x9E3779B97F4A7C15))
    code = mix(np.add.reduceat(value, ahead)) if len(begin) else np.zeros(0, np.uint64)
    return code, begin, end, np.searchsorted(begin, offsets)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, grams: int) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, anchor's place, anchor's hash) of each segment of a slice of texts, in bytes or words as ``data`` is."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    width = length - grams + 1  # grams in a string
    n = len(data) - grams + 1
    if n < width:
        return none
    h, step, base = byte_table(3)[data] if data.dtype == np.uint8 else data, 1, np.uint64(0x9E3779B97F4A7C15)
    while step < grams:
        h = h[:-step] * base + h[step:]
        base, step = np.uint64(int(base) ** 2 % (1 << 64)), 2 * step
    h = mix(h)
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, 1).ravel()
    starts = n - width + 1
    at = (np.minimum(ahead[:starts], behind[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    good = np.arange(starts) + length <= offsets[1:][text]
    change = np.ones(starts + 1, bool)
    change[1:-1] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (good[1:] != good[:-1])
    edge = np.flatnonzero(change)
    lo, size = edge[:-1], np.diff(edge)
    keep = good[lo]
    lo, size = lo[keep], size[keep]
    return text[lo], lo, size, at[lo], h[at[lo]]


def same(buffer: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each start are also those at another start. The buffer goes on 8 bytes or more behind the last string."""
    words = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    out = np.zeros(len(starts), bool)
    left = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)

    def refine(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Sorts by the keys, the last first; drops what is alone; numbers the groups of the rest."""
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        ends = np.append(new[1:], True)
        more = ~(new & ends)
        return order[more], np.cumsum(new)[more]

    for depth in range(0, min(SHALLOW, length - 7), 8):  # multikey passes
        picked, group = refine((words[starts[left] + depth].astype(np.uint64), group))
        left = left[picked]
    depth = np.full(len(left), min(SHALLOW, length) // 8 * 8, np.int64)
    while len(left):  # one level of all blind tries
        first = np.concatenate([[True], group[1:] != group[:-1]])
        leaf = left[first][np.cumsum(first) - 1]
        lcp = np.full(len(left), length, np.int64)
        todo = np.flatnonzero(left != leaf)
        d = depth[todo]
        while len(todo):
            x = words[starts[left[todo]] + d].astype(np.uint64) ^ words[starts[leaf[todo]] + d].astype(np.uint64)
            part = x != 0
            if part.any():
                zeros = np.zeros(part.sum(), np.int64)
                y = x[part]
                for shift in (32, 16, 8):
                    low = y < (np.uint64(1) << np.uint64(64 - shift))
                    zeros += low * (shift // 8)
                    y = np.where(low, y << np.uint64(shift), y)
                lcp[todo[part]] = np.minimum(d[part] + zeros, length)
            go = ~part & (d + 8 < length)
            todo, d = todo[go], d[go] + 8
        equal = lcp >= length
        twin = np.zeros(int(group.max()) + 1, np.int64)
        np.add.at(twin, group[equal], 1)
        out[left[equal]] = twin[group[equal]] > 1
        left, group, lcp = left[~equal], group[~equal], lcp[~equal]
        if not len(left):
            break
        picked, group = refine((buffer[starts[left] + lcp], lcp, group))
        left, depth = left[picked], lcp[picked] // 8 * 8
    return out


def _texts(docs: DataFrame) -> DataFrame:
    """key (MD5 of the text), data and copies of each different text, bucketed by key, so that later joins move no text."""
    spark = docs.sparkSession
    rows = docs.select(F.unhex(F.md5("text")).alias("key"), F.col("text").cast("binary").alias("data")).filter("data is not null")
    rows = rows.groupBy("key").agg(F.first("data").alias("data"), F.count("*").alias("copies"))
    name = f"edgelens_texts_{uuid.uuid4().hex}"
    taken(f"table:{name}")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with tidy(spark):
        rows.write.bucketBy(buckets, "key").sortBy("key").option("path", f"{shared_dir(spark)}/texts").format("parquet").saveAsTable(name)
    return spark.table(name)


def _segments(texts: DataFrame, length: int, unit: Unit) -> DataFrame:
    """One row for each segment: key, gram (the anchor's hash), seg (MD5-sized hash of its units), lo, n and at (its starts, and the anchor, in the text).

    For words, also first and width, the segment's bytes in the text.
    """
    places = ["lo", "n", "at"] + ["first", "width"] * (unit is WORDS)
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("gram", T.LongType()), T.StructField("seg", T.BinaryType()), *[T.StructField(c, T.IntegerType()) for c in places]])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for row, _, data, offsets in byte_slices(batch.column("data")):
                begin = None
                if unit is WORDS:
                    byte, (data, begin, end, offsets) = offsets, word_codes(data, offsets)
                text, lo, size, at, gram = anchor_runs(data, offsets, length, unit.gram)
                view, base = memoryview(np.ascontiguousarray(data)).cast("B"), offsets[text]
                seg = [hashlib.blake2b(view[unit.size * a : unit.size * (a + b + length - 1)], digest_size=16).digest() for a, b in zip(lo.tolist(), size.tolist(), strict=True)]
                found = [lo - base, size, at - base]
                if begin is not None:
                    found += [begin[lo] - byte[text], end[lo + size + length - 2] - begin[lo]]
                yield pa.record_batch([batch.column("key").take(pa.array(text + row)), pa.array(gram.view(np.int64)), pa.array(seg, pa.binary()), *[pa.array(x.astype(np.int32)) for x in found]], names=schema.names)

    return texts.select("key", "data").mapInArrow(find, schema)


def _dealt(rows: DataFrame, length: int, unit: Unit) -> DataFrame:
    """Sort groups of segments: by anchor, or, for anchors with more than MANY, by block of starts and the units that all strings of the block share. Words become their codes."""
    size = unit.size

    def units(column: pa.Array) -> list[bytes]:
        if unit is not WORDS:
            return column.to_pylist()
        out = []
        for _, _, data, offsets in byte_slices(column):
            code, _, _, at = word_codes(data, offsets)
            out += [code[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = []
            for key, gram, lo, n, at, many, copies, data in zip(*[batch.column(c).to_pylist() for c in ("key", "gram", "lo", "n", "at", "many", "copies")], units(batch.column("bytes")), strict=True):
                mark = gram.to_bytes(8, "little", signed=True)
                if not many:
                    out.append((mark, key if copies == 1 else None, lo, n, data))
                    continue
                far = at - lo  # the anchor's place in the string at the first start; it falls by one with each start
                for block in range((far - n + 1) // unit.block, far // unit.block + 1):
                    top = far - block * unit.block
                    a, b = max(0, top - unit.block + 1), min(n - 1, top)  # starts of this block
                    core = data[size * top : size * (top + length - unit.block + 1)]
                    name = hashlib.blake2b(mark + block.to_bytes(4, "little") + core, digest_size=16).digest()
                    out.append((name, key if copies == 1 else None, lo + a, b - a + 1, data[size * a : size * (b + length)]))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["mark", "key", "lo", "n", "bytes"])

    return rows.mapInArrow(cut, "mark binary, key binary, lo int, n int, bytes binary")


def _sorted_repeats(rows: DataFrame, length: int, unit: Unit) -> DataFrame:
    """(key, lo, hi) of what repeats in segments that have one copy."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(part: list[tuple]) -> pa.RecordBatch:
            sizes = np.array([len(r[4]) for r in part], np.int64)
            base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            count = np.array([r[3] for r in part], np.int64)
            owner = np.repeat(np.arange(len(part)), count)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            hit = same(np.frombuffer(b"".join(r[4] for r in part) + bytes(8), np.uint8), base[owner] + unit.size * place, unit.size * length)
            edge = np.zeros(len(hit) + 1, bool)
            edge[1:-1] = (owner[1:] != owner[:-1]) | (hit[1:] != hit[:-1])
            edge[[0, -1]] = True
            cut = np.flatnonzero(edge)
            out = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                r = part[owner[a]]
                if hit[a] and r[1] is not None:
                    out.append((r[1], r[2] + int(place[a]), r[2] + int(place[b - 1]) + length))
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            return pa.record_batch([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["key", "lo", "hi"])

        size = 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("mark", "key", "lo", "n", "bytes")], strict=True):
                if size > SORT_BYTES and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush(held)

    return rows.repartition("mark").sortWithinPartitions("mark").mapInArrow(sort, "key binary, lo int, hi int")


def _counted_repeats(rows: DataFrame, length: int, unit: Unit) -> DataFrame:
    """As ``_sorted_repeats``, for groups without a bound: strings are counted by a 128-bit hash, with partial counts before the exchange."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = []
            for key, lo, n, data in zip(*[batch.column(c).to_pylist() for c in ("key", "lo", "n", "bytes")], strict=True):
                out += [(hashlib.blake2b(data[unit.size * i : unit.size * (i + length)], digest_size=16).digest(), key, lo + i) for i in range(n)]
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["string", "key", "lo"])

    each = written(rows.mapInArrow(strings, "string binary, key binary, lo int"), "strings")
    twice = each.groupBy("string").count().filter("count > 1").select("string")
    return each.filter("key is not null").join(twice, "string", "left_semi").select("key", "lo", (F.col("lo") + length).alias("hi"))


def _repeats(texts: DataFrame, length: int, unit: Unit) -> DataFrame:
    """key and found (lo, hi): units that repeated strings cover; ranges may overlap. Texts with several copies are left out as owners."""
    segments = written(_segments(texts, length, unit), "segments")
    kinds = segments.groupBy("gram", "seg").agg(F.count("*").alias("copies"), F.min(F.struct(*[c for c in segments.columns if c not in ("gram", "seg")])).alias("one"))
    kinds = written(kinds, "kinds")
    whole = segments.join(kinds.filter("copies > 1").select("gram", "seg"), ["gram", "seg"], "left_semi").select("key", "lo", (F.col("lo") + F.col("n") - 1 + length).alias("hi"))
    whole = written(whole, "whole")
    drop(segments)
    shared = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    open_ = kinds.join(shared, "gram").select("gram", "copies", "one.*", (F.col("kinds") > MANY).alias("many"))
    part = F.substring("data", F.col("first") + 1, F.col("width")) if unit is WORDS else F.substring("data", F.col("lo") + 1, F.col("n") + length - 1)
    bytes_ = open_.join(texts.select("key", "data"), "key").select("key", "gram", "lo", "n", "at", "many", "copies", part.alias("bytes"))
    few = written(_sorted_repeats(_dealt(bytes_.filter("not many"), length, unit), length, unit), "few")
    blocks = written(_dealt(bytes_.filter("many"), length, unit), "blocks")
    drop(kinds)
    hot = written(blocks.groupBy("mark").count().filter(F.col("count") > HOT).select("mark"), "hot")
    cold = written(_sorted_repeats(blocks.join(hot, "mark", "left_anti"), length, unit), "cold")
    counted = written(_counted_repeats(blocks.join(hot, "mark", "left_semi"), length, unit), "counted")
    drop(blocks, hot)
    parts = (whole, few, cold, counted)
    found = whole.union(few).union(cold).union(counted).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))  # at most a range for each string start of a text
    found = written(found, "found")
    drop(*parts)
    return found


RESULT = "key binary, n_bytes long, n_removed long, spans array<struct<lo: long, hi: long>>, kept binary, passages array<struct<lo: long, hi: long>>"


def maximal(found: list[dict[str, int]]) -> list[dict[str, int]]:
    """The maximal runs (lo, hi) of ranges that may overlap or touch."""
    runs: list[dict[str, int]] = []
    for s in sorted(found, key=lambda s: s["lo"]):
        if runs and s["lo"] <= runs[-1]["hi"]:
            runs[-1]["hi"] = max(runs[-1]["hi"], s["hi"])
        else:
            runs.append(dict(s))
    return runs


def repeated_spans(docs: DataFrame, length: int = 400, whole: bool = True, words: int | None = None, apart: bool = False) -> DataFrame:
    """Of each different text of ``docs`` that isn't null: key (its MD5), n_bytes, n_removed, spans, kept (null unless ``whole``) and passages.

    spans are the maximal runs of bytes that strings of ``length`` bytes cover which start at another place too, of the
    same or another text; kept is what is left. Strings count as equal if they, and the hashes above, are; MD5 names texts.
    With ``words`` (16 or more), spans also cover, from the first word to the last, each sequence of so many words that
    starts at another place too, whatever its bytes and the white space between its words; passages are the maximal runs of
    bytes that these sequences cover. With ``apart``, passages are told only: spans are those without ``words``.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, removed, spans, kept, sizes, told = [], [], [], [], [], []
            for i in range(batch.num_rows):
                data, copies = batch.column("data")[i].as_buffer(), batch.column("copies")[i].as_py()
                found = batch.column("found")[i].as_py() or []
                data = bytes(data) if data is not None else b""
                if copies > 1 and len(data) >= length:
                    found = [{"lo": 0, "hi": len(data)}]
                passages = batch.column("passages")[i].as_py() or [] if words else []
                if words and (passages or copies > 1):
                    place = [m.span() for m in WORD.finditer(data)]
                    if copies > 1 and len(place) >= words:
                        passages = [{"lo": 0, "hi": len(place)}]
                    passages = [{"lo": place[p["lo"]][0], "hi": place[p["hi"] - 1][1]} for p in passages]
                runs = maximal(found if apart else found + passages)
                told.append(maximal(passages))
                keys.append(batch.column("key")[i].as_py())
                sizes.append(len(data))
                removed.append(sum(r["hi"] - r["lo"] for r in runs))
                spans.append(runs)
                kept.append(None if not whole else b"".join(data[a:b] for a, b in zip([0, *[r["hi"] for r in runs]], [*[r["lo"] for r in runs], len(data)], strict=True)))
            span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(told, span)], names=["key", "n_bytes", "n_removed", "spans", "kept", "passages"])

    texts = _texts(docs)
    rows = texts.join(_repeats(texts, length, BYTES), "key", "left").select("key", "data", "copies", "found")
    if words:
        rows = rows.join(_repeats(texts, words, WORDS).withColumnRenamed("found", "passages"), "key", "left")
    return rows.mapInArrow(finish, RESULT)


def dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of each row of ``docs`` (doc_id, text; other columns are ignored).

    Each byte of a text's UTF-8 form goes that a string of ``length`` bytes covers which starts anywhere else too, in any
    row; strings are judged on the input. Null texts count as empty. Rows that share a text of ``length`` bytes or more
    lose all of it. Rows may repeat and doc_id may be null; an empty table gives an empty table. A text is held by one
    task, at about 100 times its bytes.
    """
    found = repeated_spans(docs, length).select("key", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept")
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("key")).join(found, "key", "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.coalesce("kept", F.unhex(F.lit(""))).alias("kept"))


def dedup_digest(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """As ``dedup``, with kept_sha256 (lowercase hex) in place of kept, which then stays where it was made.

    With ``words``, also n_passages and n_passage_bytes: the maximal runs, and their bytes, that sequences of so many words
    cover which start at another place too, see ``repeated_spans``. They are told only; what is removed is as without.
    """
    counts = {"n_bytes": F.col("n_bytes"), "n_removed": F.col("n_removed"), "n_spans": F.size("spans").cast("long")}
    told = {"n_passages": F.size("passages").cast("long"), "n_passage_bytes": F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"])} if words else {}
    found = repeated_spans(docs, length, words=words, apart=True)
    found = found.select("key", *[c.alias(name) for name, c in (counts | told).items()], F.sha2("kept", 256).alias("kept_sha256"))
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("key")).join(found, "key", "left")
    zero = F.lit(0).cast("long")
    filled = {c: F.coalesce(c, zero).alias(c) for c in counts | told}
    return rows.select("doc_id", *[filled[c] for c in counts], F.coalesce("kept_sha256", F.sha2(F.lit(""), 256)).alias("kept_sha256"), *[filled[c] for c in told])


def clean(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """The rows of ``docs`` with text cut by ``dedup``; of a character that a run covers in part, all bytes stay.

    With ``words``, sequences of so many words that start twice go as well, see ``repeated_spans``. All columns but text stay as they are, whatever their names. Null texts stay null.
    """

    def inside(data: Column, p: Column, back: bool) -> Column:
        """p moved to the nearest start of a character, at most three bytes."""
        step = -1 if back else 1
        byte = [F.substring(data, p + 1 + step * i, F.lit(1)) for i in range(4)]
        later = [F.when((b >= F.unhex(F.lit("80"))) & (b < F.unhex(F.lit("C0"))), i + 1).otherwise(0) for i, b in enumerate(byte)]
        moves = F.when(later[0] == 0, 0).when(later[1] == 0, 1).when(later[2] == 0, 2).otherwise(3)
        return (p + step * moves).cast("int")

    def cut(data: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<binary>").alias("out"))

        def step(state: Column, s: Column) -> Column:
            lo, hi = inside(data, s["lo"].cast("int"), False), F.greatest(inside(data, s["hi"].cast("int"), True), state["at"])
            left = F.substring(data, state["at"] + 1, F.greatest(lo - state["at"], F.lit(0)))
            return F.struct(F.greatest(hi, lo).alias("at"), F.array_append(state["out"], left).alias("out"))

        def joined(done: Column) -> Column:
            rest = F.substring(data, done["at"] + 1, F.octet_length(data)).cast("string")
            return F.concat(F.array_join(F.transform(done["out"], lambda b: b.cast("string")), ""), rest)

        return F.transform(F.array(F.aggregate("spans", start, step)), joined)[0]

    found = repeated_spans(docs, length, whole=False, words=words).filter("n_removed > 0").select("key", "spans")
    # The row's own columns stay apart in a struct, so that none clashes with the names used here.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.unhex(F.md5("text")).alias("key")).join(found, "key", "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.transform(F.array(F.col("row.text").cast("binary")), cut)[0])
    return rows.select(*[(text if c.lower() == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
