"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths in (capacity / (k + 1), capacity / k], and each of
its bins takes k pieces. Every task fills the bins of its own rows as they come, with no exchange between tasks. Only
the few pieces of bins that stayed open at a task's end are dealt again: first by class, for groups of ``TASKS`` tasks
together, which leaves fewer than k pieces of a class and group; then what is left of a group goes into mixed bins.
Documents are cut so that little is padded: whole sequences first, and a rest that would leave more than ``SLACK`` of
its place empty gives a piece that fits the next class exactly, until the last piece fits well or is short.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelens.llm.common import written

#: Share of a place in a bin that a piece may leave empty before it is cut.
SLACK = 1 / 32
#: Pieces of at most so many tokens are not cut.
SHORT = 64
#: So many tasks pool the pieces of their open bins.
TASKS = 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, {ids}sequence_id long, offset long"


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        place = capacity // k
        piece = rest
        if rest > SHORT and place - rest > SLACK * place:
            piece = capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


class Bins:
    """Open bins by class; ``add`` gives back the pieces of a bin that became full."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, {}

    def add(self, piece: tuple) -> list[tuple]:
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self.open.pop(k) if len(held) == k else []

    def rest(self) -> Iterator[tuple]:
        for k in sorted(self.open):
            yield from self.open[k]


def placed(pieces: list[tuple], sequence: int) -> list[tuple]:
    out, at = [], 0
    for p in pieces:
        out.append((*p, sequence, at))
        at += p[2]
    return out


def mixed(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    """Bins of pieces of all classes: longest first, each into the fullest bin that has room."""
    bins: list[list[tuple]] = []
    room: list[tuple[int, int]] = []  # (room, bin), ascending
    for p in sorted(pieces, key=lambda p: -p[2]):
        i = bisect.bisect_left(room, (p[2], -1))
        left, at = room.pop(i) if i < len(room) else (capacity, len(bins))
        if at == len(bins):
            bins.append([])
        bins[at].append(p)
        bisect.insort(room, (left - p[2], at))
    return bins


def byte_ranks(tokenizer_path: str) -> dict[bytes, int] | None:
    """The ids of a byte-level tokenizer file by their bytes, if ids follow the order of merges and texts are cut by PARTS alone; else None."""
    import json
    from pathlib import Path

    from tokenizers.pre_tokenizers import ByteLevel

    whole = json.loads(Path(tokenizer_path).read_text())
    model, parts = whole["model"], whole.get("pre_tokenizer") or {}
    if whole.get("normalizer") or parts.get("type") != "ByteLevel" or parts.get("add_prefix_space", True) or not parts.get("use_regex", True):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # a byte that prints is itself; the others follow from U+0100 on
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    if set(of) != set(ByteLevel.alphabet()):
        return None
    merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    ids = [model["vocab"][m.replace(" ", "", 1)] for m in merged]
    if ids != sorted(ids) or min(ids) < max(model["vocab"][c] for c in of):
        return None
    return {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if all(c in of for c in t)}


#: How a tokenizer of this kind cuts texts before it merges.
PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White-space characters in a row from which a text goes by ``tokenizers``; ``tiktoken`` runs out of stack at about a million.
BLANKS = 100_000


def encoder(tokenizer_path: str, added_tokens: bool = False):
    """A function from texts to little-endian unsigned 32-bit ids.

    Where the file's ids follow the order of its merges, its vocabulary is run by ``tiktoken``, which gives the same ids
    as ``tokenizers`` in a sixth of the time. Any other file is run by ``tokenizers``, and so is a text with BLANKS or
    with a string of an added token: these strings are the tokens' ids if ``added_tokens``, as in the plain call of
    ``encode``, else special ones are ordinary text.
    """
    import re
    import sys
    from array import array

    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = not added_tokens
    blanks = re.compile(r"(?<!\s)\s{%d}" % BLANKS)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def by_file(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    ids_of = by_file
    if ranks := byte_ranks(tokenizer_path):
        fast = tiktoken.Encoding("text", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def ids_of(text: str) -> list[int]:
            slow = any(t in text for t in added) or len(text) >= BLANKS and blanks.search(text)
            return by_file(text) if slow else fast(text)

    def encode(text: str | None) -> bytes:
        ids = array("I", ids_of(text) if text else [])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    return encode


def _record_batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    ids = [pa.field("ids", pa.list_(pa.int32()))] if with_ids else []
    schema = pa.schema([pa.field(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + ids + [pa.field(n, pa.int64()) for n in ("sequence_id", "offset")])
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = True, added_tokens: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, ids (if ``with_ids``), sequence_id, offset.

    ``docs`` has doc_id and text; other columns are ignored. A document's tokens are its text's ids and ``end_id``, so
    null and empty texts have one token; see ``encoder`` for ``added_tokens``. Each token lies in one piece; the pieces
    of a sequence lie gapless from offset 0 and hold ``capacity`` tokens at most; the rest of a sequence is to be padded.
    Rows may repeat and doc_id may be null: each row is a document of its own. An empty table gives an empty table. A
    document is held by one task, and takes about 12 times its bytes there.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        encode, bins, task = encoder(tokenizer_path, added_tokens), Bins(capacity), TaskContext.get().partitionId()
        sequence, end = task << 32, int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + end
                n, at = len(ids) // 4, 0
                for length in cuts(n, capacity):
                    part = ids[4 * at : 4 * (at + length)]
                    piece = (doc.as_py(), at, length, zlib.crc32(part), n, *([list(memoryview(part).cast("i"))] if with_ids else []))
                    at += length
                    if full := bins.add(piece):
                        rows += placed(full, sequence)
                        sequence += 1
                if len(rows) >= 4096:
                    yield _record_batch(rows, with_ids)
                    rows = []
            yield _record_batch(rows, with_ids)
        yield _record_batch([(*p, None, task // TASKS) for p in bins.rest()], with_ids)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group and class."""
        from pyspark import TaskContext

        sequence = (1 << 61) + (TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []
        held: list[tuple] = []
        key = None
        for row in _rows(batches):
            k = capacity // row[2]
            if (row[-1], k) != key:
                rows += [(*p, None, key[0]) for p in held] if held else []
                held, key = [], (row[-1], k)
            held.append(row[:-2])
            if len(held) == k:
                rows += placed(held, sequence)
                sequence, held = sequence + 1, []
            if len(rows) >= 4096:
                yield _record_batch(rows, with_ids)
                rows = []
        yield _record_batch(rows + ([(*p, None, key[0]) for p in held] if held else []), with_ids)

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group."""
        from pyspark import TaskContext

        sequence = (1 << 62) + (TaskContext.get().partitionId() << 32)
        held: list[tuple] = []
        group = None

        def close() -> pa.RecordBatch:
            return _record_batch([x for i, bin_ in enumerate(mixed(held, capacity)) for x in placed(bin_, sequence + i)], with_ids)

        for row in _rows(batches):
            if row[-1] != group and held:
                yield close()
                sequence, held = sequence + len(held), []
            group = row[-1]
            held.append(row[:-2])
        yield close()

    schema = PIECES.format(ids="ids array<int>, " if with_ids else "")
    closed, open_ = F.col("sequence_id").isNotNull(), F.col("sequence_id").isNull()
    k = F.expr(f"{int(capacity)} div length")
    same = ("doc_id", "start", "ids_crc32", "doc_tokens", "length")  # so that a task that runs again meets the same order
    first = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fill, schema), "pieces")
    some = first.filter(open_).repartition("offset", k).sortWithinPartitions("offset", k, *same).mapInArrow(by_class, schema)
    some = written(some, "pool")
    last = some.filter(open_).repartition("offset").sortWithinPartitions("offset", *same).mapInArrow(by_group, schema)
    return first.filter(closed).union(some.filter(closed)).union(last)
