"""Removal of repeated passages by sliding spans of sentences.

Each run of ``SIZE`` consecutive sentences is hashed, and so is the whole of a text with fewer; hashes are counted over all
documents, and of each that occurs again the first place in (doc_id, row, sentence) order stays. A sentence goes if any
span that is not the first of its hash covers it. Sentences end at ``.``, ``!`` or ``?`` before white space and at
line ends. One of more than ``WORDS`` words is cut after each word whose hash is the least (the last of equals) of some
``WORDS`` words in a row of the sentence, so cuts depend on nearby words only, and no part has more than WORDS words.

So two texts that share more than 4 * WORDS words share a span of them, wherever the words stand: at each end at most
WORDS words may be cut in another way, and what is left has SIZE sentences and LEAST words at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from edgelens.llm.common import byte_slices, byte_table, drop, mix, written

#: Sentences of a span, and most words of a sentence.
SIZE, WORDS = 3, 12

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_BYTES, _STEP = byte_table(5), np.uint64(0x9E3779B97F4A7C15)


def cuts(sentence: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Of words given by the number of their sentence and their hash: whether a sentence of more than WORDS words is cut behind each."""
    reach = np.zeros(len(word), np.int64)
    for before in (True, False):
        open_ = np.ones(len(word), bool)
        for k in range(1, WORDS):
            there = np.zeros(len(word), bool)
            if before:
                there[k:] = (sentence[k:] == sentence[:-k]) & (word[:-k] >= word[k:])
            else:
                there[:-k] = (sentence[:-k] == sentence[k:]) & (word[k:] > word[:-k])
            open_ &= there
            reach += open_
    return reach + 1 >= WORDS


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts given end to end: the byte behind each sentence and its white space, its number of words, and of each text the sentences before it (and of all).

    White space at a text's start is a sentence of no words.
    """
    blank = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]])))
    stops = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]])))  # the last byte of each word
    text = np.searchsorted(offsets, starts, "right") - 1
    last = np.append(text[1:] != text[:-1], True)[: len(starts)]
    until = np.where(last, offsets[text + 1], np.append(starts[1:], 0)[: len(starts)])  # the byte behind a word's white space
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    ends = last | _STOP[data[stops]] | (lines[until] > lines[stops + 1])
    number = np.cumsum(ends) - ends
    size = np.bincount(number) if len(number) else np.zeros(0, np.int64)
    some = np.flatnonzero(size[number] > WORDS)
    if len(some):
        base = np.concatenate([[0], starts])
        place = np.arange(len(data)) - np.repeat(base, np.diff(np.append(base, len(data))))
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(place.max()), _STEP)]))
        sums = np.add.reduceat(np.where(blank, np.uint64(0), _BYTES[data] * power[place]), starts)
        ends[some] |= cuts(number[some], mix(sums[some]))
    at = np.flatnonzero(ends)
    n_words = np.diff(np.concatenate([[-1], at]))
    # A text that starts with white space has a sentence more, of no words.
    lead = np.flatnonzero((np.diff(offsets) > 0) & blank[np.minimum(offsets[:-1], max(0, len(data) - 1))]) if len(data) else np.zeros(0, np.int64)
    first = np.searchsorted(starts, offsets[:-1][lead])
    behind = np.where(first < len(starts), np.append(starts, 0)[first], len(data))
    behind = np.minimum(behind, offsets[1:][lead])
    of = np.concatenate([text[at], lead])
    behind, n_words = np.concatenate([until[at], behind]), np.concatenate([n_words, np.zeros(len(lead), np.int64)])
    order = np.argsort(behind, kind="stable")
    return behind[order], n_words[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(offsets) - 1))])


def span_ends(before: np.ndarray) -> np.ndarray:
    """The sentence behind the span that starts at each sentence; 0 where its text has too few from there on."""
    at = np.arange(before[-1])
    start, stop = (np.repeat(x, np.diff(before)) for x in (before[:-1], before[1:]))
    return np.where((at + SIZE <= stop) | (at == start), np.minimum(at + SIZE, stop), 0)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds s, the sentences of a text, and the hash of the span from each (null if there is none)."""
    md5 = hashlib.md5
    for batch in batches:
        texts = batch.column("text")
        for lo, hi, data, offsets in byte_slices(texts):
            behind, _, before = sentences(data, offsets)
            flat, begin = data.tobytes(), np.concatenate([[0], behind[:-1]])[: len(behind)]
            each = b"".join([md5(flat[a:b].strip(b" \t\n\x0b\f\r")).digest() for a, b in zip(begin.tolist(), behind.tolist(), strict=True)])
            whole = [md5(each[16 * i : 16 * k]).digest() if k else None for i, k in enumerate(span_ends(before).tolist())]
            null = pa.array(texts.slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False))
            edges = pa.array(before.astype(np.int32))
            s = pa.StringArray.from_buffers(len(behind), pa.py_buffer(np.concatenate([[0], behind]).astype(np.int32)), pa.py_buffer(flat))
            lists = [pa.ListArray.from_arrays(edges, v, mask=null) for v in (s, pa.array(whole, pa.binary()))]
            yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), batch.column("row").slice(lo, hi - lo), *lists], names=["doc_id", "row", "s", "hash"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the spans that start at its marks, and the numbers of sentences."""
    for batch in batches:
        s, marks = batch.column("s"), batch.column("marks")
        first, edges = s.offsets.to_numpy(), marks.offsets.to_numpy()
        mark = marks.values.to_numpy(zero_copy_only=False)[edges[0] : edges[-1]].astype(np.int64)
        begin, stop = (np.repeat(x, np.diff(edges)) for x in (first[:-1], first[1:]))
        begin = begin + mark
        change = np.zeros(len(s.values) + 1, np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, np.minimum(begin + SIZE, stop), -1)
        stays = np.cumsum(change[:-1]) <= 0
        before = np.concatenate([[0], np.cumsum(stays)])[first]
        null = pa.array(s.is_null().to_numpy(zero_copy_only=False))
        left = pa.ListArray.from_arrays(pa.array(before - before[0], pa.int32()), s.values.slice(first[0], first[-1] - first[0]).filter(pa.array(stays[first[0] : first[-1]])), mask=null)
        sizes = np.diff(first).astype(np.int64)
        yield pa.record_batch([batch.column("doc_id"), pc.binary_join(left, ""), pa.array(sizes), pa.array(sizes - np.diff(before))], names=["doc_id", "kept", "n_sentences", "n_removed"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, kept (what is left of the text), n_sentences and n_removed (sentences) of each row of ``docs`` (doc_id, text).

    Two spans are equal if their sentences are, but for white space at their ends; white space at a text's start is a
    sentence of its own. Three short sentences are a span like any others, so common short ones go where they repeat. Null texts have null kept and no
    sentences. Rows may repeat and doc_id may be null (first in order): rows are told apart by their place. Other columns
    are ignored; an empty table gives an empty table. Equal 128-bit hashes count as equal spans.
    """
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    lists = [StructField("s", ArrayType(StringType())), StructField("hash", ArrayType(BinaryType()))]
    rows = written(rows.mapInArrow(_spans, StructType([rows.schema["doc_id"], rows.schema["row"], *lists])), "sentences")
    spans = rows.select("doc_id", "row", F.posexplode("hash").alias("at", "hash")).filter("hash is not null")
    first = spans.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "at")).alias("first")).filter("n > 1").select("hash", "first.row", "first.at")
    first = written(first.toDF("hash", "first_row", "first_at"), "first")
    gone = spans.drop("doc_id").join(first, "hash").filter("row != first_row or at != first_at")
    marked = written(gone.groupBy("row").agg(F.collect_list("at").alias("marks")), "marked")  # at most one a sentence
    drop(first)
    out = rows.select("doc_id", "row", "s").join(marked, "row", "left").select("doc_id", "s", F.coalesce("marks", F.array().cast("array<int>")).alias("marks"))
    kinds = [StructField("kept", StringType()), StructField("n_sentences", LongType()), StructField("n_removed", LongType())]
    return out.mapInArrow(_cut, StructType([rows.schema["doc_id"], *kinds]))
