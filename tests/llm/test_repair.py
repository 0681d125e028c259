"""Conversation repair against a search over all edits, row by row."""

import hashlib
import random
import re
import zlib

from edgelens.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, symbol string, no long"


def best(symbols):
    """The least (cost, edits) by trying every edit at every row; symbols are (initial, fault)."""
    after = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("3", "u"): "2", ("2", "a"): "3"}
    memo = {}

    def go(i, state, inserted):
        key = i, state, inserted
        if key not in memo:
            ways = []
            if inserted < 2:
                ways += [(3 + c, "I" + e) for r in "ua" if (state, r) in after for c, e in [go(i, after[state, r], inserted + 1)]]
            if i == len(symbols):
                ways += [(0, "")] if state in "03" else []
            else:
                initial, fault = symbols[i]
                extra = 3 * (fault == "truncated")
                if fault not in ("blank", "duplicate"):
                    if (state, initial) in after:
                        ways += [(extra + c, "K" + e) for c, e in [go(i + 1, after[state, initial], 0)]]
                    ways += [(3 + extra + c, "R" + e) for r in "ua" if (state, r) in after for c, e in [go(i + 1, after[state, r], 0)]]
                ways += [(4 + c, "D" + e) for c, e in [go(i + 1, state, 0)]]
            memo[key] = min(ways, default=(10**9, "~"))
        return memo[key]

    return go(0, "0", 0)


def brute(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)} of damaged rows (conv_id, turn, role, text, dropped)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv and not r[4]]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        seen, symbols = set(), []
        for _, _, role, text, _ in own:
            kept = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
            seen.add((role, text))
            symbols.append((role[:1], fault))
        turns = {r[1] for r in own} - {None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:], strict=False))
        cost, audit = best(symbols)
        lines, left = [], iter(own)
        led = False
        for e in audit:
            role, text = ("", "") if e == "I" else next(left)[2:4]
            if e == "D":
                continue
            if e == "K":
                led = led or not lines and role[:1] == "s"
            else:
                role = "assistant" if (len(lines) - led) % 2 else "user"
            lines.append(f"{role}:{text}")
        counts = [sum(s[1] == k for s in symbols) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text, k == 0)] * (2 if k == 3 else 1)
    return out


def rows_of(rng, conversations):
    out = []
    for conv in range(conversations):
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "ü"])
            text = rng.choice(["Hi.", "Well?", "no end", " \t\r\n", "", None, "Yes! \x0b", "énd. ", f"own {turn}.", "a\nb.", "x" * 50])
            out.append((conv or None, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), role, text, "z", 5))
    return out


def result(df):
    return {r.conv_id: tuple(r[c] for c in [*repair.FIELDS, "audit", "repaired_sha256"]) for r in df.collect()}


def test_repair_against_all_edits(spark, monkeypatch):
    rows = rows_of(random.Random(3), 160)
    monkeypatch.setattr(repair, "CHUNK", 3)  # conversations of several chunks; workers that run already keep the usual length
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = result(repair.digests(repair.damaged(df)))
    assert found == brute(damage(rows)) and len(found) == len({r[0] for r in rows})


def test_a_long_conversation_in_many_chunks(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t}.", "open", "so.", ""]), "z", 5) for t in range(6000)]
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"{t}.", "z", 5) for t in range(3000)]
    assert result(repair.digests(repair.damaged(spark.createDataFrame(rows, SCHEMA).repartition(5)))) == brute_long(damage(rows))


def brute_long(rows):
    import sys

    before = sys.getrecursionlimit()
    sys.setrecursionlimit(100_000)
    try:
        return brute(rows)
    finally:
        sys.setrecursionlimit(before)


def test_rows_without_damage_and_repaired_rows(spark):
    rows = [(1, 0, "system", "S.", "z", 5), (1, 1, "user", "Q?", "z", 5), (1, 2, "user", "Q?", "z", 5), (1, 3, "tool", "A.", "z", 5), (1, 4, "user", "open", "z", 5), (2, 0, "assistant", "", "z", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(repair.digests(df)) == brute([(*r[:4], False) for r in rows])
    got = sorted(((r.conv_id, r.place, r.edit, r.role, r.text) for r in repair.repaired(df).collect()), key=str)
    want = [(1, 0, "K", "system", "S."), (1, 1, "K", "user", "Q?"), (1, None, "D", "user", "Q?"), (1, 2, "R", "assistant", "A."), (1, None, "D", "user", "open"), (2, None, "D", "assistant", "")]
    assert got == sorted(want, key=str)


def test_repair_of_an_empty_table_and_of_dropped_rows(spark):
    assert repair.digests(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    rows = [(5, t, "user", "a.", "z", 5) for t in range(400) if zlib.crc32(f"5:{t}".encode()) % 20 == 0]
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) > 5 and result(repair.digests(repair.damaged(spark.createDataFrame(rows, SCHEMA)))) == {5: (0, 0, 0, 0, 0, 0, "", empty)}


def test_grammar_derives_every_sequence(spark):
    rng = random.Random(5)
    sequences = ["ua" * rng.randrange(1, 300) + rng.choice(["", "x", "sU"]) for _ in range(50)] + ["".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    rules = repair.grammar(spark.createDataFrame([(s,) for s in sequences], "seq string"))
    solver = repair.Solver(tuple(rules))
    parts = {s: a + b for s, a, b in rules}

    def text(symbol):
        return "".join(map(text, parts[symbol])) if symbol in parts else symbol

    plain = repair.Solver(())
    for s in sequences:
        assert "".join(map(text, solver.compressed(s))) == s
        assert solver.whole(s) == plain.whole(s)
    assert rules and sum(len(solver.compressed(s)) for s in sequences) < sum(map(len, sequences)) / 2
