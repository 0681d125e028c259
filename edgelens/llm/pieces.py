"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text is cut into words (spaces go with the word behind them) and each word into characters. The agenda holds the
neighbours whose union is a piece, best score first and leftmost first; a keyed hash of seed, document, the word's number
in it and place in the word drops each candidate with a given probability, and a dropped candidate is skipped when its
turn comes. So each occurrence of a word draws its own segmentation, the same one each time. Words of up to ``WIDE``
characters are worked on together, one merge of every word at a time; longer ones have an agenda of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelens.llm.common import mix

WIDE = 24
#: Words that are worked on together.
BLOCK = 1 << 12
#: Symbols from here on are characters without a piece, and stand for their bytes.
OTHER = 1 << 24
#: More than any symbol, so that a pair has a key of its own.
PAIR = 1 << 26
_FAR = np.int32(1 << 30)
SPACE = "▁"


class Pieces:
    """The vocabulary of a model: characters, merges by pair of ids, ranks by score, and the bytes of each piece."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        whole = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in whole}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces must have spaces at their start only")
        self.by_rank = np.array(sorted(whole, key=lambda i: (-sp.get_score(i), i)), np.int32)
        self.rank = np.full(n, _FAR, np.int32)
        self.rank[self.by_rank] = np.arange(len(whole))
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("the model needs byte pieces")
        self.data = [b""] * n
        for p, i in self.ids.items():
            self.data[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.data[i] = bytes([b])
        made = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    made[a * PAIR + b] = i
        self.pairs, self.ranks = made, self.rank.tolist()
        self.table = np.arange(OTHER, OTHER + 0x110000, dtype=np.int32)
        for c, i in self.ids.items():
            if len(c) == 1 and c != SPACE:
                self.table[ord(c)] = i
        self.table[32] = self.ids.get(SPACE, OTHER + 32)
        # A table of twice 2**bits places: a key stands at its hash, or at the first free place behind.
        bits = max(8, (4 * len(made)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.made = np.full(2 << bits, -1, np.int64), np.full(2 << bits, -1, np.int32)
        keys = np.array(sorted(made), np.int64)
        for k, at in zip(keys.tolist(), self.place(keys).tolist(), strict=True):
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.made[at] = k, made[k]

    def symbols(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, or -1."""
        key = a.astype(np.int64) * PAIR + b
        at = self.place(key)
        found = self.keys[at]
        out = np.where(found == key, self.made[at], np.int32(-1))
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] += 1
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.made[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def spelled(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            out += [s] if s < OTHER else [self.byte[b] for b in chr(s - OTHER).encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text; its first space is the one that encoding put in front."""
        return b"".join(map(self.data.__getitem__, ids)).decode()[1:]


def occurrences(seed: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mark of each word of texts given by their keys and numbers of words: a hash of seed, key and the word's number in its text."""
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(mix(keys + np.uint64(seed)), counts) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def keyed(seed: int, word: np.ndarray, start: np.ndarray, end: np.ndarray, split: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for the candidate that joins characters start..split and split..end of a word."""
    place = (start.astype(np.uint64) << np.uint64(42)) | (split.astype(np.uint64) << np.uint64(21)) | end.astype(np.uint64)
    return (mix(mix(word + np.uint64(seed)) ^ place) >> np.uint64(11)).astype(np.float64) / 2.0**53


def together(p: Pieces, symbols: np.ndarray, sizes: np.ndarray, marks: np.ndarray, dropout: float, seed: int) -> np.ndarray:
    """Segments many words at once, given end to end: a row for each, its ids in order among -1. marks are those of ``occurrences``.

    A symbol stays at the place of its first character; places point to the symbols before and after them.
    """
    n, wide = len(sizes), int(sizes.max())
    s = np.full((n, wide), -1, np.int32)
    s[np.arange(wide) < sizes[:, None]] = symbols
    after = np.tile(np.arange(1, wide + 2, dtype=np.int32), (n, 1))
    before = after - 2
    rank = np.full((n, wide), _FAR, np.int32)  # of each symbol's union with the next

    def propose(rows: np.ndarray, at: np.ndarray) -> None:
        split = after[rows, at]
        made = p.merge(s[rows, at], s[rows, split])
        can = made >= 0
        if dropout:
            i = np.flatnonzero(can)
            r, k = rows[i], split[i]
            can[i] = keyed(seed, marks[r], at[i], after[r, k], k) >= dropout
        rank[rows, at] = np.where(can, p.rank[made], _FAR)

    propose(*np.nonzero(np.arange(wide) < sizes[:, None] - 1))
    live = np.arange(n)
    while len(live):
        held = rank[live]
        i = held.argmin(1)
        low = held[np.arange(len(live)), i]
        go = low < _FAR
        live, i, low = live[go], i[go], low[go]
        j = after[live, i]
        end = after[live, j]
        s[live, i], s[live, j] = p.by_rank[low], -1
        rank[live, i] = rank[live, j] = _FAR
        after[live, i], before[live, end] = end, i
        right, left = end < sizes[live], i > 0
        propose(np.concatenate([live[right], live[left]]), np.concatenate([i[right], before[live[left], i[left]]]))
    return s


_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    """``mix`` of one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def alone(p: Pieces, symbols: np.ndarray, mark: int, dropout: float, seed: int) -> list[int]:
    """Segments one word of any length by its own agenda; equal to ``together``.

    The first candidates are found at once. Each merge then proposes two more, by plain numbers, so the work is that of
    the agenda: the word's length times its logarithm.
    """
    n = len(symbols)
    at = np.arange(n - 1)
    made = p.merge(symbols[:-1], symbols[1:])
    kept = (made >= 0) & ~(keyed(seed, np.full(n - 1, mark, np.uint64), at, at + 2, at + 1) < dropout)
    agenda = list(zip(p.rank[made[kept]].tolist(), at[kept].tolist(), (at[kept] + 1).tolist(), (at[kept] + 2).tolist(), made[kept].tolist(), strict=True))
    heapq.heapify(agenda)
    s, after, before, end = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    pairs, rank, base = p.pairs, p.ranks, _mixed((mark + seed) & _MASK)
    while agenda:
        _, i, j, e, m = heapq.heappop(agenda)
        if s[i] < 0 or after[i] != j or s[j] < 0 or end[j] != e or end[i] != j:
            continue
        s[i], s[j], end[i], after[i] = m, -1, e, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a < 0 or (b := after[a]) >= n:
                continue
            union = pairs.get(s[a] * PAIR + s[b])
            if union is not None and (not dropout or (_mixed(base ^ ((a << 42 | b << 21 | end[b]) & _MASK)) >> 11) / 2.0**53 >= dropout):
                heapq.heappush(agenda, (rank[union], a, b, end[b], union))
    return [x for x in s if x >= 0]


def encoder(model_path: str, dropout: float, seed: int):
    """A function from texts and their keys to the ids of all texts end to end, and where each text's ids end."""
    import re

    p, cut = Pieces(model_path), re.compile(r" *[^ ]+| +")

    def segment(words: list[str], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in any order of the words, and of each word the place of its first id and their number."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        lengths, marks = lengths[order], marks[order]
        short, places = int(np.searchsorted(lengths, WIDE, "right")), order.tolist()
        count = np.zeros(len(words), np.int64)
        parts, rest = [], {at: (i, None) for i, at in enumerate(places[short:], short)}
        for lo in range(0, short, BLOCK):
            hi = min(short, lo + BLOCK)
            found = together(p, p.symbols("".join([words[i] for i in places[lo:hi]])), lengths[lo:hi], marks[lo:hi], dropout, seed)
            some = found >= 0
            for i in np.flatnonzero((found >= OTHER).any(1)).tolist():
                rest[places[lo + i]] = lo + i, found[i][some[i]].tolist()
                some[i] = False
            parts.append(found[some])
            count[lo:hi] = some.sum(1)
        for at, (i, symbols) in rest.items():
            ids = p.spelled(alone(p, p.symbols(words[at]), int(marks[i]), dropout, seed) if symbols is None else symbols)
            rest[at] = len(ids)
            parts.append(np.array(ids, np.int32))
        first, number = np.empty_like(count), np.empty_like(count)
        first[order], number[order] = np.cumsum(count) - count, count
        behind = int(count.sum())
        for at, n in rest.items():
            first[at], number[at] = behind, n
            behind += n
        return np.concatenate([np.zeros(0, np.int32), *parts]), first, number

    def encode(texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [cut.findall(" " + t) if t else [] for t in texts]
        counts = np.array(list(map(len, words)), np.int64)
        flat = [w for ws in words for w in ws]
        if dropout:
            ids, first, number = segment(flat, occurrences(seed, keys, counts))
        else:  # all occurrences of a word are alike
            kinds = {w: i for i, w in enumerate(dict.fromkeys(flat))}
            which = np.fromiter(map(kinds.__getitem__, flat), np.int64, len(flat))
            ids, first, number = segment(list(kinds), np.zeros(len(kinds), np.uint64))
            first, number = first[which], number[which]
        ends = np.concatenate([[0], np.cumsum(number)])
        ids = ids[np.arange(ends[-1]) + np.repeat(first - ends[:-1], number)]
        return ids, ends[np.cumsum(counts)]

    return encode, p


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, ids (array<int>) and decoded of each row of ``docs`` (doc_id, text; other columns are ignored).

    ``decoded`` is made from ids alone and equals the text. The document's part in the hash is its doc_id, so
    rows of one doc_id and text have the same ids. Null and empty
    texts have no ids, and null or empty decoded. A text's own U+2581, and what has no piece, goes as bytes. Rows may
    repeat and doc_id may be null; an empty table gives an empty table. Without dropout the ids are the model's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, p = encoder(model_path, dropout, seed)
        for batch in batches:
            lo, texts = 0, batch.column("text")
            while lo < batch.num_rows:
                hi, held = lo, 0
                part: list[str | None] = []
                while hi < batch.num_rows and (held < 1 << 19 or hi == lo):
                    part.append(texts[hi].as_py())
                    held += len(part[-1] or "")
                    hi += 1
                keys = batch.column("key").slice(lo, hi - lo).to_numpy().view(np.uint64)
                flat, ends = to_ids(part, keys)
                back = [None if t is None else p.decode(x.tolist()) for t, x in zip(part, np.split(flat, ends[:-1]), strict=True)]
                ends = np.concatenate([[0], ends])
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])
                lo = hi

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id").alias("key"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
