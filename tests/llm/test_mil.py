"""The quality classifier: gradients against differences, whole texts against one pass, held-out accuracy, odd input."""

import zlib

import numpy as np

from edgelens.llm import mil, queries

DOCS = "doc_id long, text string, lang string, score double, held_out string"
LABELS = "doc_id long, quality int, text string"


def small(seed=0):
    rng = np.random.default_rng(seed)
    shapes = {"W": (mil.FEATURES, mil.HIDDEN), "b": (mil.HIDDEN,), "V": (mil.HIDDEN, mil.GATES), "U": (mil.HIDDEN, mil.GATES), "w": (mil.GATES,), "c": (mil.HIDDEN,), "d": (1,)}
    return {k: rng.standard_normal(s) * 0.3 for k, s in shapes.items()}


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    w, doc = small(), np.array([0, 0, 0, 1, 2, 2])
    x, y, share = rng.standard_normal((6, mil.FEATURES)) * 0.1, np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 0.2])
    _, grad = mil.gradients(w, x, doc, y, share)
    for name, value in w.items():
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in value.shape)
            ends = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += step
                ends.append(mil.gradients(moved, x, doc, y, share)[0])
            assert abs((ends[0] - ends[1]) / 2e-5 - grad[name][at]) < 1e-6


def brute(w, text):
    """A text's score by the formula, passage by passage."""
    parts = [text[i : i + mil.PASSAGE] for i in range(0, len(text), mil.PASSAGE)] or [b""]
    xs = [mil.features(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]))[0] for p in parts]
    hs = [np.tanh(x @ w["W"] + w["b"]) for x in xs]
    s = np.array([(np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["w"] for h in hs])
    a = np.exp(s - s.max())
    a /= a.sum()
    return 1 / (1 + np.exp(-(sum(q * h for q, h in zip(a, hs, strict=True)) @ w["c"] + w["d"][0]))), len(parts), int(a.argmax()) * mil.PASSAGE, a.max()


def test_scores_against_the_formula(monkeypatch):
    monkeypatch.setattr(mil, "BLOCK", 3)
    rng = np.random.default_rng(2)
    texts = [b"", b"a", b"x" * 512, b"y" * 513, bytes(rng.integers(32, 127, 9000, np.uint8)), b"", "é ü".encode() * 400, b"THE!! " * 700, b""]
    model = mil.Model(small(3))
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = mil.score_slice(model, np.frombuffer(b"".join(texts), np.uint8), ends)
    for i, t in enumerate(texts):
        p, n, at, weight = brute(model.weights, t)
        assert np.allclose([got[0][i], got[3][i]], [p, weight], atol=1e-9) and (got[1][i], got[2][i]) == (n, at)


def test_held_out_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op13_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    tested = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    for y in (0, 1):
        right = [p == y for q, p in tested if q == y]
        assert len(right) > 5 and sum(right) / len(right) > 0.95


def test_odd_rows_and_labels(spark):
    texts = [None, "", " ", "one", "é" * 700, "word " * 30_000, "good text here. " * 50, "BAD!! $$$ %%% " * 50, "good text there. " * 50, "BAD!! ### &&& " * 50]
    rows = [(i, t, "en", 1.0, "x") for i, t in enumerate(texts)] + [(3, "one", "en", 1.0, "x"), (None, "good text", "en", 1.0, "x")]
    rows += [(100 + i, ("good text here. " if i % 2 else "BAD!! $$$ ### ") * 20, "en", 1.0, "x") for i in range(60)]
    labels = [(100 + i, i % 2, "l") for i in range(60)] + [(None, 1, "l"), (4, 7, "l"), (5, None, "l"), (6, 0, "l"), (6, 1, "l"), (999, 1, "l")]
    docs = spark.createDataFrame(rows, DOCS)
    got = mil.classify(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "held_out", "score", "predicted", "n_passages", "top_start", "top_weight"]
    by = {r.doc_id: r for r in got}
    assert [by[i].predicted for i in (6, 7, 8, 9)] == [1, 0, 1, 0]
    assert by[0].score == by[1].score and by[None].held_out is False and by[5].n_passages == -(-150_000 // mil.PASSAGE)
    assert {round(r.score, 12) for r in mil.classify(docs, spark.createDataFrame([(100, 1, "l"), (102, 1, "l")], LABELS)).collect()} == {round(3 / 4, 12)}
    assert {r.score for r in mil.classify(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert mil.classify(docs.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []
