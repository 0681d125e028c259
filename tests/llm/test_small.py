"""Small cases of each operator: nulls, empties, ties, repeats, extra columns, and brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from edgelens.llm import cover, minhash, packing, pieces, ppm, queries, secrets, spans, suffix, topk, url_filter
from edgelens.llm.common import byte_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long"


def docs(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang[i] if lang else "en", "s", 0, "k", 7) for i, t in enumerate(texts)], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_minhash_against_all_pairs(spark):
    rng = random.Random(1)
    base = [words(rng, 120) for _ in range(6)]
    texts = [None, "", " \t\n", "one two", "ONE  two", "solo", "solo"]
    for b in base:
        for changes in (0, 0, 1, 2, 3, 5, 8, 12):
            w = b.split()
            for _ in range(changes):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(w))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), words=3, percent=85).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}


def test_minhash_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 3)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    test_minhash_against_all_pairs(spark)


def test_minhash_null_ids_and_empty_table(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 5, False), (5, 5, True), (5, 5, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(rows.filter("false")).isEmpty()


def test_listed_loses_no_pair():
    for n in range(1, 80):
        for percent in (80, 85):
            assert 1 <= minhash.listed(n, 64, percent) <= min(n, 64)


def test_language_id(spark):
    rng = random.Random(2)
    sets = {"xx": "abcde", "yy": "fghij", "zz": "éüßñø"}
    texts, lang = [None, "", "123 !?"], ["xx", None, "yy"]
    for i in range(90):
        code = ["xx", "yy", "zz"][i % 3]
        texts.append(" ".join("".join(rng.choice(sets[code]) for _ in range(5)) for _ in range(20)))
        lang.append(code if i % 10 else None)
    rows = ppm.identify(docs(spark, texts, lang)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and all(r.score == 0 for r in rows[:3])
    assert all(r.lang_pred == ["xx", "yy", "zz"][i % 3] and 0.5 < r.score <= 1 for i, r in enumerate(rows[3:]))
    assert [r.held_out for r in rows] == [zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows]
    assert ppm.identify(docs(spark, texts, lang).filter("false")).isEmpty()


def test_code_lengths_are_exact():
    model = ppm.train([("a", "abab"), ("b", "ccc")])
    data = np.frombuffer(b"abz", np.uint8)
    got = ppm.code_lengths(model, data, np.array([0, 3]))[0]

    def bits(text):
        padded, out = b"\0\0\0" + text, 0.0
        train = b"\0\0\0\0\0\0" + text_of + b"\0\0\0\0\0\0"
        train = (bytes(3) + bytes(3)).join([b"", text_of])
        for i in range(3, len(padded)):
            p, order, escape = None, 3, 1.0
            while p is None:
                if order < 0:
                    p = escape / 256
                    break
                context = padded[i - order : i]
                follow = [train[k + order] for k in range(len(train) - order) if train[k : k + order] == context]
                kinds = len(set(follow))
                if follow and padded[i] in follow:
                    p = escape * follow.count(padded[i]) / (len(follow) + kinds)
                elif follow:
                    escape *= kinds / (len(follow) + kinds)
                order -= 1
            out -= np.log2(p)
        return out

    expected = []
    for text_of in (b"abab", b"ccc"):
        expected.append(bits(b"abz"))
    assert np.allclose(got, expected, rtol=1e-4)


def independent_bits(training, text, order=3):
    """Bits of a text after training texts, by counting follow-ups anew for every byte (method C, no exclusion)."""
    train, out = bytes(2 * order) + bytes(2 * order).join(training), 0.0
    text = bytes(order) + text
    for i in range(order, len(text)):
        p = 1.0
        for k in range(order, -2, -1):
            if k < 0:
                p /= 256
                break
            context = text[i - k : i]
            follow = [train[j + k] for j in range(len(train) - k) if train[j : j + k] == context]
            kinds = len(set(follow))
            if text[i] in follow:
                p *= follow.count(text[i]) / (len(follow) + kinds)
                break
            if follow:
                p *= kinds / (len(follow) + kinds)
        out -= np.log2(p)
    return out


@pytest.mark.parametrize("at_once", [1, 5, 1 << 19])
def test_code_lengths_of_random_texts(monkeypatch, at_once):
    monkeypatch.setattr(ppm, "AT_ONCE", at_once)
    rng = random.Random(13)
    train = [(lang, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60)))) for lang, letters in [("a", "ab"), ("b", "bcd"), ("c", "aé ")] for _ in range(3)]
    train.append(("d", "abab"))
    model = ppm.train(train)
    texts = [b"", b"bba", b"cab", "é€".encode(), *["".join(rng.choice("abcdé z") for _ in range(rng.randrange(20))).encode() for _ in range(30)], b""]
    got = ppm.code_lengths(model, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    expected = [[independent_bits([t.encode() for x, t in train if x == lang], text) for lang in model.langs] for text in texts]
    assert np.allclose(got, expected, rtol=1e-5)


def test_language_id_learns_every_label_and_long_documents(spark, monkeypatch):
    monkeypatch.setattr(ppm, "SAMPLE_DOCS", 80)
    monkeypatch.setattr(ppm, "TRAIN_CHARS", 50)
    rng = random.Random(14)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 5)) for _ in range(70)]  # more languages than 64
    texts, lang = [], []
    for i in range(700):
        texts.append(" ".join("".join(rng.choice(alphabets[i % 70]) for _ in range(6)) for _ in range(40)))
        lang.append(f"l{i % 70:02}" if i < 630 else None)
    rows = ppm.identify(docs(spark, texts, lang)).collect()
    assert len({r.lang_pred for r in rows}) == 70 and sum(r.lang_pred == f"l{r.doc_id % 70:02}" for r in rows) > 600


def brute_secrets(text):
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]
    out = []
    for order, (kind, p) in enumerate(kinds):
        for m in re.finditer(p, text, re.I | re.A if kind == "assign" else re.A):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def test_secrets(spark, tmp_path):
    texts = [None, "", "é😀 Token = 'abcdefgh' AKIA" + "B" * 16 + " token=ab secret: zzzzzzz " + "a" * 30 + "\n" + "x", "token=token: abcdefg secret=secret=abcdefg", "x" * 3000 + " api_key=123456", "password=" + "0" * 40]
    ledger = str(tmp_path / "ledger")
    for _ in range(2):  # the second time all is known
        got = {r.doc_id: [(f.start, f.order, f.end, f.kind) for f in r.findings] for r in secrets.find_secrets(docs(spark, texts), ledger=ledger).collect()}
        assert got == {i: brute_secrets(t or "") for i, t in enumerate(texts)}
    assert spark.read.parquet(ledger).count() == 3 * len({t or "" for t in texts})
    more = secrets.Rule("pem", 1, "BEGIN KEY")
    secrets.scan(docs(spark, texts), ledger, (*secrets.RULES, more)).count()
    assert spark.read.parquet(ledger).filter("kind = 'pem'").count() == len({t or "" for t in texts})
    masked = {r.doc_id: r.text for r in secrets.redact(docs(spark, texts)).collect()}
    assert masked[0] is None and masked[5] == "[secret]" and masked[4] == "x" * 3000 + " [secret]"
    assert secrets.find_secrets(docs(spark, ["a"]).filter("false")).isEmpty()


def test_secrets_of_long_texts_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"token=abcdef{i} AKIA{'C' * 16}{i}" for i in range(3000))
    rows = spark.createDataFrame([(1, long, "a", "b", 3), (2, "secret=1234567 x", None, "b", 4), (3, None, "c", "d", 5)], "doc_id long, text string, __found string, blob string, findings int")
    ledger = str(tmp_path / "ledger")
    secrets.scan(rows, ledger)
    spark.read.parquet(ledger).coalesce(1).write.parquet(str(tmp_path / "more"))
    spark.read.parquet(str(tmp_path / "more")).write.mode("append").parquet(ledger)  # every pair twice, as after two scans at one time
    got = {r.doc_id: r for r in secrets.find_secrets(rows, ledger=ledger).collect()}
    for r in got.values():
        assert [(f.start, f.order, f.end, f.kind) for f in r.findings] == brute_secrets(r.text or "")
    assert got[2]["__found"] is None and got[1].blob == "b" and secrets.scan(rows, ledger).count() == 9
    masked = {r.doc_id: r for r in secrets.redact(rows).collect()}
    assert masked[1].text == " ".join(["[secret] [secret]"] * 3000) and masked[2].text == "[secret] x" and masked[3].text is None
    assert [masked[i].findings for i in (1, 2, 3)] == [3, 4, 5]


def test_secrets_ledger_scans_only_unseen_pairs(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = docs(spark, ["token=abcdefg", "b", None])
    second = docs(spark, ["token=abcdefg", "b", "c", "d"])
    secrets.scan(first, ledger, secrets.RULES[:1])
    assert spark.read.parquet(ledger).count() == 3
    secrets.scan(second, ledger, secrets.RULES)
    rows = spark.read.parquet(ledger).groupBy("blob", "kind").count()
    assert rows.count() == 5 * 3 - 2 and rows.filter("count > 1").isEmpty()  # the empty text has not met the two later rules


def test_merge_dropout(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, "", "  two  spaces ", "▁ itself", "日本 😀\n\tx", "x" * 200, "the quick brown fox jumps over the lazy dog " * 20]
    plain = {r.doc_id: r for r in pieces.encode(docs(spark, texts), path, dropout=0.0).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in (1, 2, 4, 5, 6):
        assert list(plain[i].ids) == model.encode(texts[i])
    some = {r.doc_id: r for r in pieces.encode(docs(spark, texts), path, dropout=0.3, seed=9).collect()}
    again = {r.doc_id: r for r in pieces.encode(docs(spark, texts).repartition(3), path, dropout=0.3, seed=9).collect()}
    assert all(r.decoded == texts[i] for i, r in some.items()) and {i: list(r.ids) for i, r in some.items()} == {i: list(r.ids) for i, r in again.items()}
    assert len(some[6].ids) > len(plain[6].ids)


def plain_agenda(word, mark, dropout, seed, rank):
    """The pieces of a word by looking for the best candidate again and again; what is drawn is spelled out here."""
    limit = 1 << 64

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % limit
        x = (x ^ x >> 27) * 0x94D049BB133111EB % limit
        return x ^ x >> 31

    parts = [(i, i + 1) for i in range(len(word))]
    while True:
        best = None
        for k in range(len(parts) - 1):
            (a, b), (_, c) = parts[k], parts[k + 1]
            if word[a:c] in rank and word[a:b] in rank and word[b:c] in rank and (mixed(mixed((mark + seed) % limit) ^ (a << 42 | b << 21 | c) % limit) >> 11) / 2**53 >= dropout:
                best = min(best or (rank[word[a:c]], k), (rank[word[a:c]], k))
        if best is None:
            return [word[a:b] for a, b in parts]
        k = best[1]
        parts[k : k + 2] = [(parts[k][0], parts[k + 1][1])]


def test_merge_dropout_against_a_plain_agenda():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    rank = {sp.id_to_piece(i): r for r, i in enumerate(sorted(whole, key=lambda i: (-sp.get_score(i), i)))}
    model, rng = pieces.Pieces(path), random.Random(4)
    base = "internationalization of unspaced writing systems 日本語のテキストには空白がありません ไม่มีช่องว่าง".split()
    for size in (1, 2, 5, 23, 24, 25, 60, 200):
        for dropout in (0.0, 0.1, 0.5):
            word = ("▁" + "".join(rng.choice(base) for _ in range(size)))[:size]
            mark, seed = rng.randrange(1 << 64), 7
            want = plain_agenda(word, mark, dropout, seed, rank)
            symbols = model.symbols(word.replace("▁", " "))
            got = pieces.alone(model, symbols, mark, dropout, seed)
            assert [sp.id_to_piece(i) if i < pieces.OTHER else chr(i - pieces.OTHER) for i in got] == want
            grid = pieces.together(model, symbols, np.array([len(symbols)]), np.array([mark], np.uint64), dropout, seed)
            assert grid[grid >= 0].tolist() == got


def test_a_text_without_spaces_takes_time_by_its_length():
    model, rng = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model")), random.Random(5)
    text = "".join(rng.choice(["nation", "al", "ization", "ing", "の", "本", "un"]) for _ in range(300_000))
    began = time.process_time()
    ids = pieces.alone(model, model.symbols(" " + text), 5, 0.1, 1)
    assert time.process_time() - began < 20
    assert model.decode(model.spelled(ids)) == text


def test_merge_dropout_is_drawn_for_each_occurrence(spark):
    path, text = public_tokenizers.path("piece_bpe_32k.model"), "international " * 300 + " " + "y" * 30
    rows = pieces.encode(docs(spark, [text, text]), path, dropout=0.3, seed=5).withColumn("key", F.xxhash64("doc_id")).collect()
    model = pieces.Pieces(path)
    for r in rows:
        at = pieces.occurrences(5, np.array([r.key]).view(np.uint64), np.array([301]))
        each = [pieces.alone(model, model.symbols(w), int(m), 0.3, 5) for w, m in zip([" international"] * 300 + ["  " + "y" * 30], at, strict=True)]
        assert [i for ids in each for i in model.spelled(ids)] == r.ids
        assert len({tuple(ids) for ids in each}) > 20
    assert rows[0].ids != rows[1].ids and all(r.decoded == text for r in rows)


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(11)
    alone, twice, one, two, many, none = (words(rng, 150, 10**6) for _ in range(6))
    rows = [(None, alone), (1, twice), (1, twice), (2, one), (2, two), (3, one), (None, many), (5, many + " more"), (5, many), (None, none), (None, none), (None, "123 456"), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(None, alone), (1, twice), (2, one), (2, two), (5, {many + " more", many}), (None, none), (None, "123 456"), (None, None)]

    def held(found):
        left = list(found)
        for d, t in kept:
            hit = next(x for x in left if x[0] == d and x[1] in (t if isinstance(t, set) else {t}))
            left.remove(hit)
        assert not left

    held((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {t: len(model.encode(t).ids) + 1 for t in (alone, twice, one, two, none)}
    found = sorted((str(r.doc_id), r.doc_tokens) for r in got if r.start == 0 and r.doc_id != 5)
    assert found == sorted((str(d), sizes[t]) for d, t in kept if not isinstance(t, set) and t in sizes) and sum(r.doc_id == 5 and r.start == 0 for r in got) == 1


def test_sentence_spans(spark):
    rng = random.Random(3)
    passage = ". ".join(words(rng, 9) for _ in range(6)) + ". "
    long = words(rng, 60)
    texts = [None, "", words(rng, 5), passage + words(rng, 30), "Start here. " + passage + "End there.", words(rng, 16) + " " + long, words(rng, 32) + " " + long, words(rng, 80)]
    got = {r.doc_id: r for r in spans.dedup(docs(spark, texts)).collect()}
    assert got[0].kept is None and got[1].kept == "" and got[3].n_removed == 0 and got[7].kept == texts[7]
    assert got[4].kept == "Start here. End there." and len(got[6].kept.split()) < 60
    assert spans.dedup(docs(spark, ["a"]).filter("false")).isEmpty()


def brute_cuts(long):
    """The words behind which a sentence of more than 12 words is cut: the least hash of each 12 words in a row, of equal ones the last."""
    table, limit = [int(x) for x in byte_table(5)], 1 << 64

    def hashed(word):
        x = sum(table[c] * pow(0x9E3779B97F4A7C15, i, limit) for i, c in enumerate(word.encode())) % limit
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % limit
        x = (x ^ x >> 27) * 0x94D049BB133111EB % limit
        return x ^ x >> 31

    h = [hashed(re.match(r"\S+", w, re.A)[0]) for w in long]
    return {min(range(i, i + 12), key=lambda k: (h[k], -k)) for i in range(len(h) - 11)}


def brute_spans(texts):
    """Sentences as strings, and the numbers of those that go; nothing of the module is used."""
    out, seen, gone = [], {}, [set() for _ in texts]
    for t in texts:
        parts = re.findall(r"\A\s+|\S+\s*", t or "", re.A)
        whole, s = [], []
        for p in parts:
            s.append(p)
            if not p.strip() or "\n" in p or p.strip()[-1] in ".!?":
                whole, s = [*whole, s], []
        done = []
        for s in [*whole, s] if s else whole:
            cut = brute_cuts(s) if len(s) > 12 else set()
            line = ""
            for i, w in enumerate(s):
                line += w
                if i in cut or i == len(s) - 1:
                    done.append(line)
                    line = ""
        out.append(done)
    for d, s in enumerate(out):
        for i in range(max(1, len(s) - 2) if s else 0):
            if seen.setdefault(tuple(x.strip() for x in s[i : i + 3]), (d, i)) != (d, i):
                gone[d] |= set(range(i, min(i + 3, len(s))))
    return out, gone


def test_copies_lose_everything_however_short(spark):
    texts = ["a b. c d. e f.", "One sentence of just these thirteen words, and it ends here. Second one.", "x", "x\n", "so. it. is. not. long. at. all.", "a b. c d.", "I. II. Q b1. c1. d1.", "b1. c1. d1."]
    got = {r.doc_id: r for r in spans.dedup(docs(spark, texts + texts[:2] + [texts[2], texts[4], texts[5]])).collect()}
    assert all(got[i].kept == texts[i] for i in (0, 1, 2, 4, 5, 6, 7)) and got[3].kept == ""
    assert all(got[i].kept == "" for i in range(8, 13))
    sentences, gone = brute_spans(texts)
    assert all(got[i].n_removed == len(gone[i]) and got[i].n_sentences == len(sentences[i]) for i in range(8))


def test_exact_copies_of_the_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    kept = {r.doc_id: r.kept for r in spans.dedup(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    seen, copies = set(), 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        if r.text in seen:
            copies += 1
            assert kept[r.doc_id] == ""
        seen.add(r.text)
    assert copies > 50


def test_sentence_spans_at_any_place(spark):
    rng = random.Random(8)
    texts = [None, "", " \n ", "  led by  white\tspace\n\nand ended\x0b by it. \n"]
    verse = "".join(f"w{rng.randrange(99)} w{rng.randrange(99)}\n" for _ in range(20))
    texts += [verse, words(rng, 7) + "\n" + verse, "WORD!! " * 40, "So: " + "WORD!! " * 40]
    pairs = []
    for at in range(25):  # 51 words without and with sentence ends
        for ends in (0, 0.1, 0.5):
            passage = " ".join(w + ("." if rng.random() < ends else "") for w in words(rng, 51, 10**6).split())
            pairs.append(len(texts))
            texts += [words(rng, 30, 10**6) + " " + passage + " " + words(rng, 9, 10**6), words(rng, at + 1, 10**6) + " " + passage + " " + words(rng, 23, 10**6)]
    got = {r.doc_id: r for r in spans.dedup(docs(spark, texts)).collect()}
    sentences, gone = brute_spans(texts)
    for i, r in got.items():
        kept = None if texts[i] is None else "".join(s for k, s in enumerate(sentences[i]) if k not in gone[i])
        assert (r.kept, r.n_sentences, r.n_removed) == (kept, len(sentences[i]), len(gone[i]))
    assert got[5].n_removed == 20 and got[7].kept in ("So: WORD!! ", "So: ")
    assert all(got[i].n_removed == 0 and got[i + 1].n_removed for i in pairs)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(4)
    texts = [None, "", "<|endoftext|> a  b \n", *[words(rng, rng.randrange(1, 900)) for _ in range(60)]]
    rows = packing.pack(docs(spark, texts), path, capacity=256).collect()
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert len(ids.setdefault(r.doc_id, [])) == r.start and len(r.ids) == r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        ids[r.doc_id] += r.ids
    assert ids == {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    bins = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.setdefault(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 256 and sum(bins.values()) > 0.9 * 256 * len(bins)


def test_packing_of_long_white_space_and_other_files(tmp_path):
    import json
    from pathlib import Path

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "a" + " " * 1_200_000 + "b\n c"
    model = Tokenizer.from_file(path)
    assert np.frombuffer(packing.encoder(path)(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(json.loads(Path(path).read_text()) | change))
        assert np.frombuffer(packing.encoder(str(other))("Some TEXT"), "<u4").tolist() == Tokenizer.from_file(str(other)).encode("Some TEXT", add_special_tokens=False).ids


def test_packing_query_as_the_contract_calls_the_tokenizer(spark, tmp_path):
    from edgelens.llm.queries import op6_packing
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts = [None, "", "<|endoftext|> a  b \n", "x<|endoftext|><|endoftext|>", *[words(rng, rng.randrange(1, 900)) for _ in range(40)]]
    docs(spark, texts).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, bins = op6_packing(spark, str(tmp_path)).collect(), {}
    for r in rows:
        ids = [*model.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.setdefault(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] += r.length
    assert sum(r.length for r in rows if r.doc_id == 2) == len(model.encode(texts[2], add_special_tokens=False).ids) + 1
    assert max(bins.values()) <= 2048 and sum(bins.values()) > 0.95 * 2048 * (len(bins) - 1)


@pytest.mark.parametrize("capacity", [256, 2048])
def test_cuts_add_up(capacity):
    for n in (1, 5, 63, 64, 65, 255, 256, 257, 2047, 2048, 10_001):
        assert sum(packing.cuts(n, capacity)) == n and max(packing.cuts(n, capacity)) <= capacity


def test_cover_tree(spark, monkeypatch):
    monkeypatch.setattr(cover, "NODE", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 8))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.3, base + rng.normal(size=base.shape) * 0.1, base[:5]])
    rows = [(i, v.tolist(), i % 2, "e") for i, v in enumerate(x)]
    odd = [(900, None, 0, ""), (901, [0.0] * 8, 0, ""), (902, [float("nan")] * 8, 0, ""), (903, [None] * 8, 0, ""), (904, [1.0], 0, ""), (905, base[0].tolist(), None, ""), (906, [float("inf")] * 8, 1, "")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, cid string"), 0.9).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.9) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    reach = np.linalg.matrix_power(linked.astype(float), 64) > 0
    assert {i: got[i] for i in range(len(x))} == {i: (int(linked[i].sum()) - 1, int(np.flatnonzero(reach[i])[0])) for i in range(len(x))}
    assert all(got[i] == (0, i) for i in range(900, 907))


@pytest.mark.parametrize("node", [8, 40])
def test_cover_tree_of_many_levels(spark, monkeypatch, node):
    """A tight group that links as a whole, groups of all widths, vectors spread evenly, and copies."""
    monkeypatch.setattr(cover, "NODE", node)
    rng = np.random.default_rng(15)
    base = rng.normal(size=(12, 6))
    groups = [base[[0]] + rng.normal(size=(90, 6)) * 0.01, base[[1]] + rng.normal(size=(60, 6)) * 0.12]
    groups += [base[[i]] + rng.normal(size=(12, 6)) * rng.uniform(0.01, 0.5) for i in range(2, 12)]
    x = np.concatenate([*groups, rng.normal(size=(120, 6)), base[:3], base[:3]])
    label = np.where(np.arange(len(x)) < 150, 0, rng.integers(0, 2, len(x)))
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover.near_duplicates(rows, 0.93).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    reach = linked
    for _ in range(9):
        reach = (reach.astype(float) @ reach.astype(float)) > 0
    assert got == {i: (int(linked[i].sum()) - 1, c := int(np.flatnonzero(reach[i])[0]), c == i) for i in range(len(x))}


def figures(spark, x):
    """Leaves, pairs of leaves left, how often a vector is shipped on average, and the rows of the query, of one label."""
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(8)
    reach = float(np.sqrt(2 - 2 * 0.93)) + cover.ROUND
    vectors, nodes = cover.grown(cover._classes(df), reach)
    near, _ = cover.traversed(nodes, reach)
    leaves = vectors.select("node").distinct().count()
    shipped = cover._shipped(near, vectors).count() / vectors.count()
    return leaves, near.count(), shipped, {r.vec_id: (r.n_links, r.component_id) for r in cover.near_duplicates(df, 0.93).collect()}


def brute_links(x):
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    parts, i, j = np.arange(len(x)), [], []
    for lo in range(0, len(x), 1000):
        a, b = np.nonzero(unit[lo : lo + 1000] @ unit.T >= 0.93)
        keep = a + lo != b
        i.append(a[keep] + lo)
        j.append(b[keep])
    i, j = np.concatenate(i), np.concatenate(j)
    parts = cover.least_of_group(len(x), i, j)
    return {k: (int(n), int(c)) for k, (n, c) in enumerate(zip(np.bincount(i, minlength=len(x)), parts, strict=True))}


def test_clustered_vectors_are_pruned(spark):
    rng = np.random.default_rng(21)
    base = rng.normal(size=(75, 16))
    x = base[rng.integers(0, 75, 6_000)] + rng.normal(size=(6_000, 16)) * 0.14
    leaves, near, shipped, got = figures(spark, x)
    assert got == brute_links(x)
    assert leaves > 40 and near < 0.6 * leaves * (leaves + 1) / 2 and shipped <= 6


def test_evenly_spread_vectors_are_shipped_once_a_bin(spark):
    x = np.random.default_rng(22).normal(size=(6_000, 16))
    leaves, near, shipped, got = figures(spark, x)
    assert got == brute_links(x)
    assert shipped <= -(-6_000 // cover.NODE) + 1


def test_url_rules(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "b.org/x")]
    urls = [(1, "http://A.Example.COM/en/71?q"), (2, "http://example.com/en/8#f"), (3, "x://com/en/"), (4, "http://notcom/en/"), (5, None), (6, "no url"), (7, "http://b.org"), (8, "http://c.b.org/xy"), (9, "")]
    rows = spark.createDataFrame([(i, u, "h") for i, u in urls], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows, rules).collect()}
    assert got == {
        1: ("a.example.com", "/en/71", "example.com/en/7", "allow"), 2: ("example.com", "/en/8", "com/en/", "block"), 3: ("com", "/en/", "com/en/", "block"), 4: ("notcom", "/en/", None, "allow"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("b.org", "", None, "allow"), 8: ("c.b.org", "/xy", "b.org/x", "block"), 9: ("", "", None, "allow"),
    }


def test_contract_rules(spark):
    """The five rules as the contract words them: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    from edgelens.llm.queries import URL_RULES

    cases = {
        "http://a.com/en/": ("com/en/", "block"), "http://www.example.com/en/71": ("example.com/en/7", "allow"), "http://example.com/en/8": ("com/en/", "block"),
        "http://a.net/de/8": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://x.example.net/de/8?q": ("example.net/de/8", "block"),
        "http://b.org/es/#f": ("org/es/", "block"), "http://b.org/en/": (None, "allow"), "http://example.com/EN/7": (None, "allow"),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(rows, URL_RULES).collect()}
    assert got == dict(enumerate(cases.values()))


def test_cascade_is_exact(spark):
    keys = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.filter("substring(key, 2) % 7 = 0")
    cascade = url_filter.Cascade(listed, keys, 40_000)
    assert len(cascade.levels) > 2
    assert keys.filter(cascade.holds(F.col("key"))).exceptAll(listed).isEmpty() and keys.filter(cascade.holds(F.col("key"))).count() == listed.count()


def test_pipeline_language_id_without_any_lang(spark):
    import corpus_pipeline

    rows = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "123", None, "s", 3), (None, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [tuple(r) for r in corpus_pipeline.language_id(spark, rows, "").collect()] == [(1, "some words", None, "s", 10)]


def test_suffix_clean_keeps_clashing_columns(spark):
    text = "ab" * 100 + "é tail"
    rows = spark.createDataFrame([(1, text, "k", "s", "d"), (2, None, None, "s", "d")], "doc_id long, text string, key string, spans string, data string")
    got = sorted((tuple(r) for r in suffix.clean(rows, 130).collect()), key=lambda r: r[0])
    removed = brute_suffix([text], 130)[0][1]
    assert [r[2:] for r in got] == [("k", "s", "d"), (None, "s", "d")] and got[1][1] is None and removed and len(got[0][1].encode()) == len(text.encode()) - removed


def test_scratch_leaves_nothing(spark):
    import os

    from edgelens.llm.common import scratch

    top = spark.conf.get("spark.checkpoint.dir")
    def left():
        return set(os.listdir(top)) if os.path.isdir(top) else set(), {t.name for t in spark.catalog.listTables()}

    before = left()
    with scratch(spark):
        suffix.dedup(docs(spark, ["a" * 900, "b"])).collect()
        minhash.near_duplicates(docs(spark, ["a b c", "a b c"])).collect()
    assert left() == before


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 8)), 2) * rng.uniform(0.1, 2, (300, 1))
    x[50:60] = x[40:50]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (500, [float("nan")] * 8, 0), (None, x[0].tolist(), 0)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")).collect()}
    whole = np.floor(x * 1024).astype(np.int64)
    expected = {}
    for q in (0, 100, 200):
        score = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:10]
        expected |= {(q, k + 1): (int(i), int(score[i])) for k, i in enumerate(order)}
    assert got == expected


@pytest.mark.parametrize("block", [2, 8192])
def test_topk_with_repeated_ids(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(40, 4)), 2)
    ids = [*range(30), 0, 0, 0, 3, 3, 200, 200, 300, 400, 500]
    x[30] = x[0]  # the query's row once more, and two other rows of its vec_id
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect())
    whole, expected = np.floor(x * 1024).astype(np.int64), []
    for at, q in enumerate(ids):
        if q % 100 == 0:
            scored = sorted((-int(whole[i] @ whole[at]), v) for i, v in enumerate(ids) if i != at)[:5]
            expected += [(q, k + 1, v, -s) for k, (s, v) in enumerate(scored)]
    assert got == sorted(expected)


def brute_suffix(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = {}
    for i, b in enumerate(data):
        mask = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mask[p : p + length] = b"\1" * length
        out[i] = (len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest())
    return out


@pytest.mark.parametrize(("many", "hot"), [(1, 2048), (512, 2048), (1, 0), (1, 3)])
def test_suffix_dedup(spark, monkeypatch, many, hot):
    monkeypatch.setattr(suffix, "MANY", many)
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(7)
    base = "".join(rng.choice("abcdé fgh") for _ in range(900))
    texts = [None, "", base, base, "ab" * 100, "x" * 131, "x" * 129]
    for _ in range(12):
        at = rng.randrange(600)
        texts.append("".join(rng.choice("abé ") for _ in range(60)) + base[at : at + rng.randrange(100, 300)] + words(rng, 10))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup_digest(docs(spark, texts), 130).collect()}
    assert got == brute_suffix(texts, 130)
    whole = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in suffix.dedup(docs(spark, texts), 130).collect()}
    assert whole == {i: x[3] for i, x in brute_suffix(texts, 130).items()}
    assert all("\ufffd" not in (r.text or "") for r in suffix.clean(docs(spark, texts), 130).collect())
    assert suffix.dedup(docs(spark, ["a"]).filter("false")).isEmpty()


def brute_passages(text, texts, length, least):
    """``text`` without what strings of ``length`` bytes or of ``least`` words cover that start twice in ``texts``."""
    seen, data = Counter(), text.encode()
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())] for t in texts]
    for t, place in zip(texts, spans, strict=True):
        b = t.encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
        seen.update(tuple(b[lo:hi] for lo, hi in place[i : i + least]) for i in range(len(place) - least + 1))
    gone = bytearray(len(data))
    for p in range(len(data) - length + 1):
        if seen[data[p : p + length]] > 1:
            gone[p : p + length] = b"\1" * length
    place = spans[texts.index(text)]
    for i in range(len(place) - least + 1):
        if seen[tuple(data[lo:hi] for lo, hi in place[i : i + least])] > 1:
            lo, hi = place[i][0], place[i + least - 1][1]
            gone[lo:hi] = b"\1" * (hi - lo)
    return bytes(x for x, m in zip(data, gone, strict=True) if not m).decode()


@pytest.mark.parametrize(("many", "hot"), [(512, 2048), (1, 0), (1, 3)])
def test_suffix_clean_by_words(spark, monkeypatch, many, hot):
    """Passages of 20 words, whose bytes are under 130, go from wherever they stand; ASCII only, so that runs hold whole characters."""
    monkeypatch.setattr(suffix, "MANY", many)
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(17)
    base = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(300)]
    texts = ["", " \n", "la " * 19, "la " * 40, " ".join(base[:20]), " ".join(base[:19]), "z" * 140, "z" * 129 + " y"]
    texts += [" ".join(base[40:70])] * 2 + ["\t\n".join(base[100:125]) + "\n", words(rng, 20) + " " + words(rng, 20), "q " + "\t".join(base[:20]) + " r"]
    for k in range(14):
        at = rng.randrange(270)
        texts.append(words(rng, 6) + "\n" + " ".join(base[at : at + rng.randrange(15, 30)]) + " " * (k % 3) + words(rng, 9))
    got = {r.doc_id: r.text for r in suffix.clean(docs(spark, [*texts, None]), 130, words=20).collect()}
    assert got == {i: brute_passages(t, texts, 130, 20) for i, t in enumerate(texts)} | {len(texts): None}
    assert sum(got[i] != t for i, t in enumerate(texts)) > 8 and got[4] == "" and got[5] == texts[5]


def brute_runs(text, texts, least):
    """The maximal runs of bytes of ``text`` that sequences of ``least`` words cover which start twice in ``texts``."""
    seen, spans = Counter(), {}
    for t in texts:
        b = (t or "").encode()
        spans[t] = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        seen.update(tuple(w for _, _, w in spans[t][i : i + least]) for i in range(len(spans[t]) - least + 1))
    gone = bytearray(len((text or "").encode()))
    for i in range(len(spans[text]) - least + 1):
        part = spans[text][i : i + least]
        if seen[tuple(w for _, _, w in part)] > 1:
            lo, hi = part[0][0], part[-1][1]
            gone[lo:hi] = b"\1" * (hi - lo)
    return [m.span() for m in re.finditer(b"\1+", bytes(gone))]


@pytest.mark.parametrize(("many", "hot"), [(512, 2048), (1, 0)])
def test_suffix_digest_tells_passages(spark, monkeypatch, many, hot):
    """Passages of 20 words are told of, also where they have under 130 bytes; what goes is as without them."""
    monkeypatch.setattr(suffix, "MANY", many)
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(23)
    base = [rng.choice("abcdéfgh") * rng.randrange(1, 4) for _ in range(200)]
    texts = [None, "", " \n", "la " * 19, "lo " * 40, " ".join(base[:20]), " ".join(base[:19]), "z" * 140, "z" * 140, "y " * 300, "y " * 300]
    texts += [" ".join(base[40:70])] * 2 + [words(rng, 20), "q " + "\t".join(base[:20]) + " r " + "\n".join(base[100:120]) + " ", " ".join(base[100:120]) + "\x0b" + " ".join(base[:20])]
    for _ in range(8):
        at = rng.randrange(170)
        texts.append(words(rng, 6) + "\n" + " ".join(base[at : at + rng.randrange(15, 30)]) + " " + words(rng, 9))
    got = {r.doc_id: r for r in suffix.dedup_digest(docs(spark, texts), 130, words=20).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute_suffix(texts, 130)
    runs = [brute_runs(t, texts, 20) for t in texts]
    assert {i: (r.n_passages, r.n_passage_bytes) for i, r in got.items()} == {i: (len(x), sum(b - a for a, b in x)) for i, x in enumerate(runs)}
    assert got[5].n_passages == 1 and got[5].n_removed == 0 and got[14].n_passages == 2 and got[7].n_removed == 140 and got[7].n_passages == 0


def test_suffix_query_tells_passages_of_over_50_words(spark, tmp_path):
    """Two documents share 51 words of under 400 bytes, two others 50."""
    rng = random.Random(29)
    shared = [words(rng, n, 60) for n in (51, 50)]
    assert all(len(p) < 400 for p in shared)
    texts = [f"{words(rng, 9)} {shared[k // 2]} {words(rng, 9)}" for k in range(4)]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.n_passages, r.n_passage_bytes) for r in queries.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 1, len(shared[0])), 1: (0, 1, len(shared[0])), 2: (0, 0, 0), 3: (0, 0, 0)}


def test_suffix_words_at_text_ends():
    """Words end with their text, and equal words have equal codes wherever they stand."""
    data = ["ab c", "", "c ab\n", "abc", " ", "b\u00a0a"]
    raw = [t.encode() for t in data]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    code, begin, end, at = suffix.word_codes(np.frombuffer(b"".join(raw), np.uint8), offsets)
    found = [b"".join(raw)[a:b] for a, b in zip(begin, end, strict=True)]
    assert found == [w for b in raw for w in re.findall(rb"[^\x20\x09-\x0D]+", b)] and at.tolist() == [0, 2, 2, 4, 5, 5, 6]
    assert len(set(code.tolist())) == len(set(found)) and code[0] == code[3] and code[1] == code[2]


def test_a_second_version_scans_what_was_changed(spark, tmp_path):
    rng = random.Random(6)
    texts = ["key = password=hunter22 " + words(rng, n) + f" token: abcdef{n} " for n in (5, 20, 900, 1500)] + [None, ""]
    df, ledger = docs(spark, texts), str(tmp_path / "ledger")
    secrets.scan(df.select(secrets.earlier(F.col("text")).alias("text")), ledger)
    first = spark.read.parquet(ledger)
    seen, n = {r.blob for r in first.select("blob").distinct().collect()}, first.count()
    found = {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in secrets.find_secrets(df, ledger=ledger).collect()}
    now = spark.read.parquet(ledger)
    new = {r.blob for r in now.select("blob").distinct().collect()} - seen
    assert new == {hashlib.sha256(texts[i].encode()).hexdigest() for i in (2, 3)}  # the long ones, which were added to
    assert now.count() == n + len(new) * len(secrets.RULES)
    assert found == {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in secrets.find_secrets(df).collect()} and len(found[3]) == 2


def test_pipeline_language_id_keeps_columns_of_the_same_names(spark):
    import corpus_pipeline

    texts = [("the cat and the dog are in the house " * 5, "en"), ("der hund und die katze sind im haus " * 5, "de")] * 30
    rows = [(i, t, None if i % 7 == 0 else lang, "s", len(t), 1.0, "mine", True) for i, (t, lang) in enumerate(texts)] + [(99, "1234", "en", "s", 4, 2.0, "x", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, Lang_Pred string, held_out boolean")
    got = corpus_pipeline.language_id(spark, df, "")
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted((i, t, texts[i][1], *rest) for i, t, _, *rest in rows[:-1])


def test_many_languages_take_memory_by_what_they_have_seen():
    rng = random.Random(7)
    rows = []
    for i in range(200):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzàéîõüßñçøåæœ") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
        rows += [(f"l{i:03}", " ".join(rng.choice(own) for _ in range(1300))) for _ in range(3)]
    model = ppm.learn(rows)
    assert len(model.langs) == 200 and model.size() < 500 << 20
    tested = [(lang, " ".join(text.split()[:40])) for lang, text in rows[::41]]
    data = [t.encode() for _, t in tested]
    bits = ppm.code_lengths(model, np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in data])]))
    assert [model.langs[i] for i in bits.argmin(1)] == [lang for lang, _ in tested]
    small = ppm.learn(rows, most=model.size() // 2)
    assert small.langs == model.langs and small.size() < model.size()
