"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of which only the whole is labelled. Every passage is encoded; gated attention learns from
the documents' labels how much each passage counts; the score is that of the weighted passage representation:

    h = tanh(x W + b);  s = (tanh(h V) * sigmoid(h U)) w;  a = softmax of s over the document;  score = sigmoid(sum a h . c + d)

Learning takes a bounded sample of labelled documents (see ``sample``); scoring reads whole texts, passage by passage, and
keeps of a document only its running softmax, so a text's length doesn't matter.

A null text counts as empty, and an empty text is one passage without bytes. Labels other than 0 and 1, those of null ids
and ids that have both count for nothing. Where not both labels are known, every score is the smoothed share of label 1.
Rows that repeat an id are scored one by one; a null doc_id is not held out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from edgelens.llm.common import byte_slices, byte_table, written

#: Bytes of a passage, hash bins of its byte trigrams, and the sizes of encoding and attention.
PASSAGE, BINS, HIDDEN, GATES = 512, 512, 32, 16
#: Documents of each label that are learnt from, and the most characters that such a document may have.
TRAIN_DOCS, TRAIN_CHARS = 2000, 20_000
EPOCHS, BAGS, RATE, DECAY = 20, 64, 3e-3, 1e-4
#: Passages that are encoded together.
BLOCK = 2048

# Kinds of bytes whose shares are features: upper case, lower case, digits, line ends, other white space, marks, other ASCII, beyond ASCII.
KINDS = np.full(256, 6, np.int64)
KINDS[65:91], KINDS[97:123], KINDS[48:58], KINDS[[10, 13]], KINDS[[32, 9, 11, 12]], KINDS[128:] = 0, 1, 2, 3, 4, 7
KINDS[list(b"#$%&*|<>{}[]\\^~_=+")] = 5
N_KINDS = 8
#: Bins of runs of RUN bytes, of which only the number in use is a feature: repeated words leave many empty.
RUN, RUN_BINS = 6, 1024
FEATURES = BINS + N_KINDS + 3


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each passage's representation and attention logit."""
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        return h, (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["w"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def passages(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each passage of texts with the offsets ``ends``; a text has one at least."""
    counts = np.maximum(1, -(-np.diff(ends) // PASSAGE))
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = ends[:-1][doc] + place * PASSAGE
    return start, np.minimum(start + PASSAGE, ends[1:][doc]), doc


_MIX = byte_table(13)[:RUN]


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of passages that follow each other in ``data``: roots of hashed byte trigrams' shares, shares of kinds, variety of runs and trigrams, length."""
    n = len(start)
    lengths = end - start
    part = data[start[0] : end[-1]]
    of = np.repeat(np.arange(n), lengths)
    out = np.zeros((n, FEATURES), np.float32)
    if not len(part):
        return out
    wide = part.astype(np.uint64)
    padded = np.concatenate([wide, np.zeros(2, np.uint64)])
    left = np.repeat(end - start[0], lengths) - np.arange(len(part))  # bytes up to the passage's end
    h = wide * _MIX[0] + padded[1:-1] * _MIX[1] * (left > 1) + padded[2:] * _MIX[2] * (left > 2)
    grams = np.bincount(of * BINS + (h >> np.uint64(55)).astype(np.int64), minlength=n * BINS).reshape(n, BINS)
    some = np.maximum(lengths, 1)[:, None]
    out[:, :BINS] = np.sqrt(grams / some)
    out[:, BINS : BINS + N_KINDS] = 2 * np.bincount(of * N_KINDS + KINDS[part], minlength=n * N_KINDS).reshape(n, N_KINDS) / some
    run = np.zeros(len(part), np.uint64)
    padded = np.concatenate([wide, np.zeros(RUN, np.uint64)])
    for k in range(RUN):
        run += padded[k : k + len(part)] * _MIX[k] * (left > k)
    runs = np.bincount(of * RUN_BINS + (run >> np.uint64(54)).astype(np.int64), minlength=n * RUN_BINS).reshape(n, RUN_BINS)
    out[:, -3] = (runs > 0).sum(1) / (RUN_BINS * -np.expm1(-some[:, 0] / RUN_BINS))
    out[:, -2] = (grams > 0).sum(1) / np.minimum(some[:, 0], BINS)
    out[:, -1] = lengths / PASSAGE
    return out


def _softmax(s: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    e = np.exp(s - np.maximum.reduceat(s, first)[doc])
    return e / np.add.reduceat(e, first)[doc]


def gradients(w: dict[str, np.ndarray], x: np.ndarray, doc: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The weighted log loss of bags and its gradient; ``doc`` numbers the bags of the passages ``x`` from 0 on."""
    first = np.searchsorted(doc, np.arange(len(y)))
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    a = _softmax((t * g) @ w["w"], first, doc)
    z = np.add.reduceat(a[:, None] * h, first)
    p = _sigmoid(z @ w["c"] + w["d"])
    loss = -float((share * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum())
    do = share * (p - y)
    dz = do[:, None] * w["c"]
    of = dz[doc]
    da = (of * h).sum(1)
    ds = a * (da - np.add.reduceat(a * da, first)[doc])
    gates = ds[:, None] * w["w"]
    dt, dg = gates * g * (1 - t * t), gates * t * g * (1 - g)
    dh = (a[:, None] * of + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
    return loss, {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ do, "d": do.sum(keepdims=True)}


def learn(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """The model of labelled texts, both labels given; each label has half of the loss. By Adam over shuffled bags."""
    rng = np.random.default_rng(seed)

    def start(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {"W": start(FEATURES, HIDDEN) * 3, "b": np.zeros(HIDDEN, np.float32), "V": start(HIDDEN, GATES), "U": start(HIDDEN, GATES), "w": start(GATES), "c": start(HIDDEN), "d": np.zeros(1, np.float32)}
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin, end, doc = passages(np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    x = np.concatenate([features(data, begin[i : i + BLOCK], end[i : i + BLOCK]) for i in range(0, len(begin), BLOCK)])
    y = np.array(labels, np.float32)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32) * len(y)
    bounds = np.searchsorted(doc, np.arange(len(y) + 1))
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs)
        for i in range(0, len(y), BAGS):
            some = order[i : i + BAGS]
            rows = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in some])
            of = np.repeat(np.arange(len(some)), bounds[some + 1] - bounds[some])
            _, grad = gradients(w, x[rows], of, y[some], share[some] / len(some))
            step += 1
            for k in w:
                m[k] += 0.1 * (grad[k] - m[k])
                v[k] += 0.001 * (grad[k] ** 2 - v[k])
                w[k] -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + DECAY * w[k])
    return Model(w)


def score_slice(model: Model, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score, number of passages, start of the passage with most attention and its weight of each text of a slice.

    Blocks of passages meet by a running softmax: each document's largest logit, sum of weights and weighted sum.
    """
    n = len(ends) - 1
    start, end, doc = passages(ends)
    top, total, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
    best, best_at = np.full(n, -np.inf), np.zeros(n, np.int64)
    for i in range(0, len(start), BLOCK):
        lo, hi, d = start[i : i + BLOCK], end[i : i + BLOCK], doc[i : i + BLOCK]
        h, s = model.encoded(features(data, lo, hi))
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        own = d[first]
        high = np.maximum.reduceat(s, first)
        now = np.maximum(top[own], high)
        e = np.exp(s - np.repeat(now, np.diff(np.concatenate([first, [len(d)]]))))
        old = np.exp(top[own] - now)
        total[own] = total[own] * old + np.add.reduceat(e, first)
        z[own] = z[own] * old[:, None] + np.add.reduceat(e[:, None] * h, first)
        at = np.array([f + int(np.argmax(s[f:t])) for f, t in zip(first, [*first[1:], len(d)], strict=True)])
        more = high > best[own]
        best[own[more]], best_at[own[more]] = high[more], (lo[at] - ends[own])[more]
        top[own] = now
    w = model.weights
    p = _sigmoid((z / total[:, None]) @ w["c"] + w["d"])
    return p.astype(float), np.bincount(doc, minlength=n), best_at, np.exp(best - top) / total


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves 1 modulo 3; such rows' labels are not learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, each: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> list[tuple[bytes, int]]:
    """Texts and labels to learn from: of each label the documents with the least hashes of their ids, ``each`` at most.

    Documents that are held out, or longer than ``chars``, are not taken. What comes to the driver is bounded by
    2 * each * chars characters.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2"))
    known = known.filter("y = y2").select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    out = []
    for y in (0, 1):
        ids = written(known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(2 * each).select("doc_id", "h"), "ids")  # some are too long
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").filter(F.length("text") <= chars)
        out += [(r["text"].encode(), y) for r in texts.orderBy("h", "doc_id", "text").limit(each).collect()]
    return out


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, and top_start (in bytes) and top_weight of the passage that counts most."""
    known = sample(docs, labels)
    ones = sum(y for _, y in known)
    model = learn([t for t, _ in known], [y for _, y in known]) if 0 < ones < len(known) else None
    return score(docs, model, (ones + 1) / (len(known) + 2))


def score(docs: DataFrame, model: Model | None, share: float = 0.5) -> DataFrame:
    """The rows of ``classify`` by a model; without one every score is ``share``."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo, hi, data, ends in byte_slices(batch.column(2)):
                if model is None:
                    _, _, doc = passages(ends)
                    found.append((np.full(hi - lo, share), np.bincount(doc, minlength=hi - lo), np.zeros(hi - lo, np.int64), np.ones(hi - lo)))
                else:
                    found.append(score_slice(model, data, ends))
            if found:
                p, n, at, weight = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array(n, pa.int64()), pa.array(at, pa.int64()), pa.array(weight, pa.float64())],
                    names=["doc_id", "held_out", "score", "predicted", "n_passages", "top_start", "top_weight"],
                )

    schema = StructType([rows.schema["doc_id"]]).add("held_out", "boolean").add("score", "double").add("predicted", "integer").add("n_passages", "long").add("top_start", "long").add("top_weight", "double")
    return rows.mapInArrow(run, schema)
