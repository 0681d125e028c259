"""Rules of files, rules that are off, and many keywords against each one by itself."""

import json
import random

import pytest
from pyspark.sql import functions as F

from edgelens.operators import signatures
from edgelens.operators.signatures import Rule


def write(path, raw):
    path.write_text(json.dumps(raw))
    return str(path)


def test_rules_of_a_file(tmp_path):
    first = {"id": "A", "severity": 7, "targets": ["query"], "keywords": ["UNION", "x"], "regex": "union", "action": "block", "name": "n", "tags": ["t"]}
    got = signatures.load_rules(write(tmp_path / "a.json", {"rules": [first, {"id": "B", "keywords": ["k"]}, {"id": "C", "regex": "[0-9]+", "severity": -2, "enabled": False}]}))
    assert got[0] == Rule("A", 7, ("query",), ("union", "x"), "union", "block", None, "n", ("t",))
    assert got[1] == Rule("B", 5, ("any",), ("k",)) and got[2] == Rule("C", 5, ("any",), (), "[0-9]+", enabled=False)
    assert signatures.rule_count(got) == 2
    assert signatures.load_rules(write(tmp_path / "b.json", [first]))[0].id == "A" and signatures.load_rules(write(tmp_path / "c.json", [])) == []


@pytest.mark.parametrize("bad", [{"keywords": ["k"]}, {"id": "A"}, {"id": "A", "regex": "("}])
def test_rules_that_cannot_work(tmp_path, bad):
    with pytest.raises(Exception):
        signatures.load_rules(write(tmp_path / "a.json", [bad]))


def test_a_rule_that_is_there_twice(tmp_path):
    with pytest.raises(ValueError, match="twice"):
        signatures.load_rules(write(tmp_path / "a.json", [{"id": "A", "keywords": ["k"]}] * 2))


def test_rules_that_are_off_count_for_nothing(spark):
    rows = spark.createDataFrame([("a=evil",)], "query string")
    rules = [Rule("ON", 3, ("query",), ("evil",), enabled=True), Rule("OFF", 50, ("query",), ("evil",), action="block", enabled=False), Rule("AS-IS", 4, ("query",), ("evil",))]
    row = signatures.verdicts(rows, rules).first()
    assert (row.matches, row.score, row.block) == (["ON", "AS-IS"], 7, False)
    row = signatures.verdicts(rows, [Rule("OFF", 50, ("query",), ("evil",), enabled=False)]).first()
    assert (row.matches, row.score, row.block) == ([], 0, False)


def test_many_keywords(spark, monkeypatch):
    monkeypatch.setattr(signatures, "PIECE", 64)  # so that keywords lie across pieces
    rng = random.Random(1)
    letters = "abcé日 \n%"
    keywords = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(5000)] + ["", "a", "日", "aaaa", "aaaaa", "zzzz"]
    texts = [None, "", "a", "zzz", "xzzzzx", "a" * 500] + ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 700))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r.f for r in df.select("i", signatures.present_many(F.col("text"), keywords).alias("f")).collect()}
    known = [k for k in dict.fromkeys(keywords) if k]
    for i, t in enumerate(texts):
        assert (got[i] or []) == [k for k in known if t is not None and k in t]
    assert df.select(signatures.present_many(F.col("text"), []).alias("f")).filter("size(f) > 0").isEmpty()
