"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of what followed. A byte costs
-log2 of its probability in the longest context that the language has seen; a byte new to a context escapes to the
context shorter by one (method C: of n follow-ups of d kinds, the escape has d / (n + d)), and at last to all bytes
alike. Statistics are frozen after training, so the costs of all runs of bytes that any language of a group of GROUP
has seen are worked out once, for all of them: a byte of a text takes the row of its longest such run, and the escapes of
the contexts above it. Rows hold the group's languages only, so the model grows with what languages have seen, not with
its product with their number. The language with the shortest code length for the whole text wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgelens.llm.common import byte_slices

#: Bytes of context.
ORDER = 3
#: Bounds of the training sample: documents of a language, characters of a document, and documents of all languages.
TRAIN_DOCS, TRAIN_CHARS, SAMPLE_DOCS = 300, 8_192, 19_200
#: Languages whose costs share a row, and bytes of a model at most: beyond them half of each language's sample is learnt.
GROUP, MODEL_BYTES = 8, 400 << 20
#: Costs (bytes of text times languages) that are summed at once.
AT_ONCE = 1 << 19


@dataclass
class Table:
    """Of one order and group: the runs (context and byte) that any of its languages has seen and their costs, and the contexts and their escapes, in bits by language."""

    keys: np.ndarray
    costs: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray  # 0 for a language that has not seen the context


@dataclass
class Model:
    langs: list[str]
    symbols: np.ndarray  # of each byte; what training has not seen shares the last
    groups: list[list[Table]]  # of each GROUP languages, by order

    def size(self) -> int:
        return sum(a.nbytes for tables in self.groups for t in tables for a in (t.keys, t.costs, t.contexts, t.escapes))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def sample(docs: DataFrame) -> DataFrame:
    """(lang, text) to learn from: of each language about TRAIN_DOCS documents, of a longer one a piece of TRAIN_CHARS.

    Where there are more than SAMPLE_DOCS / TRAIN_DOCS languages each has fewer, one at least; beyond SAMPLE_DOCS
    languages the most frequent are learnt. Documents and pieces are taken by hash, so the same ones each time. Hashes
    are thinned by the language's count first, so that no task gathers a language.
    """
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_DOCS).collect()
    most = max(1, min(TRAIN_DOCS, SAMPLE_DOCS // max(1, len(counts))))
    counts = docs.sparkSession.createDataFrame([tuple(r) for r in counts], "lang string, count long")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    thin = rows.join(F.broadcast(counts), "lang").withColumn("place", place).filter(F.col("place") / F.lit(1 << 30) * F.col("count") < 2 * most + 32)  # with so many expected, none is left without
    begin = F.pmod("place", F.greatest(F.lit(1), F.length("text") - TRAIN_CHARS + 1)).cast("int")
    thin = thin.select("doc_id", "lang", "place", F.substring("text", begin + 1, F.lit(TRAIN_CHARS)).alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    return thin.withColumn("i", first).filter(F.col("i") <= most).select("lang", "text")


def train(rows: list[tuple[str, str]]) -> Model | None:
    """The model of (lang, text) rows; None for no rows."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    texts = [np.frombuffer((bytes(ORDER) + bytes(ORDER)).join([b"", *[t.encode() for x, t in rows if x == lang]]), np.uint8) for lang in langs]
    seen = np.unique(np.concatenate(texts))
    symbols = np.full(256, len(seen), np.int64)
    symbols[seen] = np.arange(len(seen))
    size = len(seen) + 1
    return Model(langs, symbols, [_tables([symbols[data] for data in texts[i : i + GROUP]], size) for i in range(0, len(langs), GROUP)])


def learn(rows: list[tuple[str, str]], most: int = MODEL_BYTES) -> Model | None:
    """As ``train``, from all rows where the model takes ``most`` bytes at most, else from every second row of each language, and so on while they have two."""
    while True:
        model = train(rows)
        if model is None or model.size() <= most or len(rows) == len(model.langs):
            return model
        by: dict[str, list[tuple[str, str]]] = {}
        for row in sorted(rows):
            by.setdefault(row[0], []).append(row)
        rows = [row for own in by.values() for row in own[::2]]


def _tables(texts: list[np.ndarray], size: int) -> list[Table]:
    """The tables of a group's languages, given by the symbols of their texts."""
    tables: list[Table] = []
    for order in range(ORDER + 1):
        grams = []  # of each language its (context * size + symbol) keys and their counts
        for s in texts:
            grams.append(np.unique(sum(s[k : len(s) - order + k] * size ** (order - k) for k in range(order + 1)), return_counts=True))
        keys = np.unique(np.concatenate([k for k, _ in grams]))
        contexts = np.unique(keys // size)
        if order:
            lower = tables[-1]
            shorter = lower.costs[np.searchsorted(lower.keys, keys % size**order)].astype(np.float64)
        else:
            shorter = np.full((len(keys), len(texts)), 8.0)
        costs, escapes = np.empty((len(keys), len(texts)), np.float32), np.zeros((len(contexts), len(texts)), np.float32)
        for i, (k, n) in enumerate(grams):
            at = np.searchsorted(contexts, k // size)
            total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
            known, whole = total > 0, (total + kinds).clip(1)
            escapes[known, i] = -np.log2(kinds[known] / whole[known])
            costs[:, i] = shorter[:, i] + escapes[np.searchsorted(contexts, keys // size), i]
            costs[np.searchsorted(keys, k), i] = -np.log2(n / whole[at])
        tables.append(Table(keys, costs, contexts, escapes))
    return tables


def _bits(tables: list[Table], key: np.ndarray, size: int) -> np.ndarray:
    """Bits of the last symbol of each run of ORDER + 1 symbols, by language of a group."""

    def place(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return at, known[at] == wanted

    whole = tables[ORDER]
    at, hit = place(whole.keys, key)
    out = whole.costs[at].astype(np.float64)
    todo = np.flatnonzero(~hit)
    out[todo] = 0
    key = key[todo]
    for order in reversed(range(ORDER + 1)):
        table = tables[order]
        if order < ORDER:
            at, hit = place(table.keys, key)
            out[todo[hit]] += table.costs[at[hit]]
            todo, key = todo[~hit], key[~hit]
        if not len(todo):
            return out
        at, hit = place(table.contexts, key // size)
        out[todo[hit]] += table.escapes[at[hit]]
        key = key % size**order
    out[todo] += 8.0
    return out


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text of a slice under each language; zero bytes stand before a text."""
    size, zero = int(model.symbols.max()) + 1, int(model.symbols[0])
    total = np.zeros((len(offsets) - 1, len(model.langs)))
    step = max(1, AT_ONCE // min(GROUP, len(model.langs)))
    for lo in range(0, len(data), step):
        hi = min(len(data), lo + step)
        at = np.arange(lo, hi)
        text = np.searchsorted(offsets, at, "right") - 1
        place = at - offsets[text]
        s = model.symbols[data[max(0, lo - ORDER) : hi]]
        s = np.concatenate([np.full(hi - lo + ORDER - len(s), zero), s])
        key = s[ORDER:]
        for back in range(1, ORDER + 1):
            key = key + np.where(place < back, zero, s[ORDER - back : len(s) - back]) * size**back
        edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        for i, tables in enumerate(model.groups):
            total[text[edge], i * GROUP : (i + 1) * GROUP] += np.add.reduceat(_bits(tables, key, size), edge, 0)
    return total


def identify(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang) with held_out, lang_pred, score and bits_per_byte.

    The model learns from the text and lang of rows with lang whose doc_id isn't held out (see ``sample``). lang_pred is
    ``und`` where the text is null or has no letter, and everywhere if there is nothing to learn from; score is then 0,
    else the winner's share of 2 ** -(bits per byte of whole code length, at most 32 bytes), summed over languages, in
    0 to 1. Of languages with equal code lengths the first in text order wins. A null doc_id counts as not held out.
    Other columns stay, but for those with the added names, which are replaced; rows may repeat; an empty table gives an
    empty table. A text is held by one task; beyond its own bytes that takes memory of constant size.
    """
    spark = docs.sparkSession
    model = learn([tuple(r) for r in sample(docs).collect()])  # at most SAMPLE_DOCS * TRAIN_CHARS characters: 157 MB of ASCII
    added = ("held_out", "lang_pred", "score", "bits_per_byte")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    if model is None:
        return docs.select(*kept, held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    shared = spark.sparkContext.broadcast((model.langs, model.symbols, [[(t.keys, t.costs, t.contexts, t.escapes) for t in tables] for tables in model.groups]))  # MODEL_BYTES at most

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, symbols, groups = shared.value
        known = Model(langs, symbols, [[Table(*t) for t in tables] for tables in groups])
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(at)):
                bits = code_lengths(known, data, offsets)
                best = bits.argmin(1)
                sizes = np.diff(offsets)
                scale = np.minimum(32, sizes) / np.maximum(1, sizes)
                share = 1 / np.exp2((bits.min(1, keepdims=True) - bits) * scale[:, None]).sum(1)
                own = bits[np.arange(len(best)), best] / np.maximum(1, sizes)
                letters = batch.column("letters").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                pred = [known.langs[b] if x else "und" for b, x in zip(best.tolist(), letters.tolist(), strict=True)]
                names = batch.schema.names[:-1]
                cols = [batch.column(c).slice(lo, hi - lo) for c in names]
                cols += [pa.array(pred, pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(np.where(letters, own, 0.0))]
                yield pa.record_batch(cols, names=[*names, "lang_pred", "score", "bits_per_byte"])

    names = docs.select(*kept, held).columns
    plain = [f"c{i}" for i in range(len(names))]
    at = next(i for i, c in enumerate(names) if c.lower() == "text")
    rows = docs.select(*kept, held, F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters")).toDF(*plain, "letters")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(predict, f"{schema}, lang_pred string, score double, bits_per_byte double")
    return out.toDF(*names, "lang_pred", "score", "bits_per_byte")
