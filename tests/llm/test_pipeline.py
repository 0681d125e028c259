"""Each stage of the pipeline on 30 documents against a plain version of it, on what the stage before kept."""

import random
import re

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, findings string, component_id long, spans int"
EN, DE = "the and of to in is that for with this house river under stone light".split(), "der und die das ist nicht mit auf ein haus fluss unter stein licht wenn".split()


def prose(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) + (f"{rng.randrange(10**6)}" if rng.random() < 0.3 else "") for _ in range(n)) + "."


def documents():
    rng = random.Random(11)
    texts = [(prose(rng, EN if i % 2 else DE, rng.randrange(40, 160)), "en" if i % 2 else "de") for i in range(20)]
    passage = prose(rng, EN, 90)  # over 400 bytes
    long = [(prose(rng, EN, 30) + " " + passage + " " + prose(rng, EN, 30), "en") for _ in range(2)]
    near = [(texts[1][0] + " once more", "en"), (texts[2][0], "de")]
    secret = [(prose(rng, EN, 20) + " password=hunter2hunter AKIA" + "ABCD1234" * 3 + " é " + "0123456789abcdef" * 2 + " " + prose(rng, EN, 9), None)]
    odd = [("1234 !!", "en"), ("", "en"), (None, "de"), (passage, "en"), ("ü" * 300 + " " + "ü" * 300, "de")]
    return [(i, t, lang, f"s{i % 3}", len(t or ""), "mine", 5, i) for i, (t, lang) in enumerate(texts + long + near + secret + odd)]


def near_plain(rows):
    sets = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1].lower())
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set())
    part = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
    return [r for i, r in enumerate(rows) if part[i] == i]


def suffix_plain(rows):
    data = [r[1].encode() for r in rows]
    seen = {}
    for d in data:
        for i in range(len(d) - 399):
            seen[d[i : i + 400]] = seen.get(d[i : i + 400], 0) + 1
    out = []
    for r, d in zip(rows, data, strict=True):
        gone = [False] * len(d)
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        text, at = "", 0
        for c in r[1]:  # a character stays unless all its bytes go
            n = len(c.encode())
            text += "" if all(gone[at : at + n]) else c
            at += n
        if re.search(r"[^\x20\x09-\x0D]", text):
            out.append((r[0], text, *r[2:4], len(text), *r[5:]))
    return out


def mask_plain(rows):
    patterns = [(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1), ("AKIA[A-Z0-9]+", 20, 0), ("[0-9a-f]+", 24, 0)]
    out = []
    for r in rows:
        spans = [m.span() for p, least, group in patterns for m in re.finditer(p, r[1]) if len(m[group]) >= least]
        text, at = "", 0
        for lo, hi in sorted(spans):
            if lo >= at:
                text += r[1][at:lo] + "[secret]"
            at = max(at, hi)
        text += r[1][at:]
        out.append((r[0], text, *r[2:4], len(text), *r[5:]))
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and what each stage but the last gave, as rows."""
    at = tmp_path_factory.mktemp("stages")
    held = [sorted(documents(), key=lambda r: r[0])]
    df = spark.createDataFrame(held[0], SCHEMA).repartition(4)
    for k, (_, work) in enumerate(corpus_pipeline.STAGES[:-1]):
        work(spark, df, "").write.parquet(f"{at}/{k}")
        df = spark.read.parquet(f"{at}/{k}")
        assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        held.append(sorted(map(tuple, df.collect()), key=lambda r: r[0]))
    return held


def test_language_id(stages):
    """Texts with a letter stay, but for the last, which fits no language better than chance, and get the language they are written in."""
    kept = [r for r in stages[0] if r[1] and re.search("[^\\W\\d_]", r[1])][:-1]
    assert [r[:2] + r[3:] for r in stages[1]] == [r[:2] + r[3:] for r in kept] and stages[0][-1][1].startswith("üü")
    assert [r[2] for r in stages[1]] == ["de" if r[0] < 20 and r[0] % 2 == 0 or r[0] == 23 else "en" for r in kept]


def test_near_dedup(stages):
    assert stages[2] == near_plain(stages[1]) and len(stages[2]) == len(stages[1]) - 2


def test_suffix_dedup(stages):
    assert stages[3] == suffix_plain(stages[2])
    assert sum(r[4] for r in stages[3]) < sum(len(r[1]) for r in stages[2]) - 1000 and len(stages[3]) < len(stages[2])


def test_suffix_dedup_takes_short_passages(spark):
    """A passage of over 50 words that two documents hold goes from both, also where it has under 400 bytes; one of 50 words stays."""
    rng = random.Random(5)
    passage, under = " ".join(rng.choices(EN, k=55)), " ".join(rng.choices(DE, k=50))
    assert len(passage.encode()) < 400
    ends = [prose(rng, EN, 12) for _ in range(8)]
    texts = [f"{ends[2 * k]} {(passage, passage, under, under)[k]} {ends[2 * k + 1]}" for k in range(4)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t), "", 0, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.text, r.n_chars) for r in dict(corpus_pipeline.STAGES)["suffix-array dedup"](spark, df, "").collect()}
    left = [f"{ends[0]}  {ends[1]}", f"{ends[2]}  {ends[3]}", *texts[2:]]
    assert got == {i: (t, len(t)) for i, t in enumerate(left)}


def test_mask_secrets(stages):
    assert stages[4] == mask_plain(stages[3]) and sum(r[1].count("[secret]") for r in stages[4]) == 3
