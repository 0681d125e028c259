"""The filter interaction audit against its definition, document by document and order by order."""

import re
from fractions import Fraction
from itertools import permutations
from math import factorial

from edgelens.llm import audit

DOCS = "doc_id long, text string, source string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int, source string"


def brute(docs, labels):
    marks = {}
    for d, q, t, _ in labels:
        if d is not None:
            old = marks.get(d, (False, False))
            marks[d] = (old[0] or q == 1, old[1] or t == 1)
    rows = []
    for d, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        least = min((o[0] for o in docs if (o[1] or "") == text and o[0] is not None), default=None)
        bad = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > least,
        }
        rows.append((source or "", {k for k, v in bad.items() if v}, *marks.get(d, (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                failing = [r for r in own if letter in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {letter} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[letter] += len(gone)
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                out[part, "".join(order), step].append(total[letter])
    return out


def test_audit_against_every_order(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    docs = [
        (1, clean, "a", "x", 0), (2, clean, "b", "x", 0), (3, clean, None, "x", 0), (3, clean, "a", "x", 0), (None, clean, "a", "x", 0), (None, clean, "a", "x", 0),
        (4, None, "a", "x", 0), (5, "", "", "x", 0), (6, " \t\x0b\r\n", "b", "x", 0), (7, "A B#", "a", "x", 0), (8, "a " * 70, "a", "x", 0), (9, "ÀÉ " + clean, "b", "x", 0),
        (10, clean.upper(), "a", "x", 0), (11, clean.upper() + " 5%", "a", "x", 0), (12, clean + " |", "b", "x", 0), (13, "a\xa0b " * 30, "b", "x", 0), (14, "word " * 40_000, "a", "x", 0),
        (15, clean + " |", "b", "x", 0), (16, clean + " |", "a", "x", 0), (0, "one", "a", "x", 0), (17, "one", "a", "x", 0),
    ]
    labels = [(1, 1, 0, "l"), (2, 1, 1, "l"), (3, 0, 1, "l"), (3, 1, None, "l"), (None, 1, 1, "l"), (7, 1, 1, "l"), (12, 1, 0, "l"), (99, 1, 1, "l")]
    got = audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got}
    assert len(got) == len(found) and found == brute(docs, labels)


def test_audit_of_an_empty_table(spark):
    assert audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def test_weights_are_those_of_all_orders():
    for n in (1, 2, 3, 5):
        weights = audit.shapley_weights(n)
        for i in range(n):
            want = [Fraction(0)] * (1 << n)
            for order in permutations(range(n)):
                before = sum(1 << p for p in order[: order.index(i)])
                want[before | 1 << i] += Fraction(1, factorial(n))
                want[before] -= Fraction(1, factorial(n))
            assert weights[i][1:] == want[1:]
