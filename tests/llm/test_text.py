"""Look-alikes, leakage, shared spans, mixing."""

import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cantera.llm import leakage, lookalike, mixing, spans

rng = random.Random(9)


# Look-alikes


def test_composition_is_that_of_the_standard():
    pool = [
        *range(0x41, 0x7B), *range(0xC0, 0x250), *range(0x300, 0x370), *range(0x300, 0x330), *range(0x1100, 0x1113), *range(0x1161, 0x1176),
        *range(0x11A8, 0x11C3), *range(0xAC00, 0xAC40), 0x9BE, 0x9C7, 0x9D7, 0x1EA0, 0x1F00, 0x345, 0x30AB, 0x3099, 0xFB2A, 0x1D15E, 0x2126, 0x1F3B5,
    ]
    texts = ["".join(chr(rng.choice(pool)) for _ in range(rng.randint(0, 12))) for _ in range(20000)] + [None, ""]
    got = lookalike.fold(pa.array(texts, pa.string()), lookalikes=False).to_pylist()
    assert got == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]


SAME = [
    ["Hello world", "Ｈｅｌｌｏ world", "Неllо wоrld", " Hello world​", "Hello world", "﻿Hello world　", "He­llo world"],
    ["Café", "Café", "Саfé"],
    ["Scaffold", "Scaﬀold"], ["Kelvin", "Kelvin"], ["a-b", "a‐b", "a‑b"], ["グ", "ｸﾞ", "グ"], ["", " ", "​", "\t⁠"],
    ["Ёлка", "Ёлка"], ["한", "한"],
]
DIFFERENT = ["Hello world", "hello world", "Hello  world", "Héllo world", "Hello, world", "Helo world", "x²", "x2", "①", "1", "λεψ", "лев", "ﬁn", "ſin"]


def test_what_looks_the_same_comes_out_the_same():
    for group in SAME:
        assert len(set(lookalike.fold(pa.array(group)).to_pylist())) == 1, group
    assert len(set(lookalike.fold(pa.array(DIFFERENT)).to_pylist())) == len(DIFFERENT)
    flat = [x for g in SAME for x in g]
    once = lookalike.fold(pa.array(flat))
    assert lookalike.fold(once).to_pylist() == once.to_pylist()
    assert lookalike.fold(pa.array(["x", *flat], pa.string()).slice(1)).to_pylist() == once.to_pylist()


def test_letters_of_one_script_stay_apart():
    for low, high in ((0x391, 0x3CA), (0x410, 0x450)):
        letters = [chr(c) for c in range(low, high) if chr(c).isalpha()]
        folded = lookalike.fold(pa.array(letters)).to_pylist()
        assert len(set(folded)) == len(letters)


def test_no_two_letters_of_one_script_are_alike():
    met = defaultdict(list)
    for letter, plain in lookalike.LOOKALIKES.items():
        script = unicodedata.name(letter).split()[0]
        if script != "LATIN":
            met[script, plain].append(letter)
    assert [x for x in met.values() if len(x) > 1 and unicodedata.category(x[0])[0] == "L"] == []
    assert len(set(lookalike.fold(pa.array(["УЛ", "ҮЛ"])).to_pylist())) == 2


def test_look_alike_rows(spark):
    rows = [(3, "Abc", None, 1), (1, "Аbc", "x", 1), (2, "Abc", "x​", 1), (4, "abc", None, 1), (5, None, "", 1), (6, "Abc", " ", 1), (2, "Abc", "x​", 1)]
    df = spark.createDataFrame(rows, "row_id long, title string, artist string, value int")
    got = {tuple(r) for r in lookalike.look_alike_rows(df, "row_id", ["title", "artist"]).collect()}
    assert got == {("title", 1, 2), ("title", 1, 3), ("title", 1, 6), ("artist", 1, 2), ("artist", 5, 6)}
    assert lookalike.look_alike_rows(df.limit(0), "row_id", ["title"]).count() == 0
    long = spark.createDataFrame([(1, "ｘ" * 200_000), (2, "x" * 200_000)], "row_id long, title string")
    assert lookalike.look_alike_rows(long, "row_id", ["title"]).count() == 1


# Leakage

ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "Alpha, beta; GAMMA delta—epsilon zeta eta theta iota kappa"), (3, "too short"),
         (4, None), (5, "One two three four five six seven eight nine ten and on")]
DOCS = [
    (1, "xx ONE two,  three four five six seven eight nine ten yy", 0), (2, "one two three four five six seven eight nine", 0),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 0), (4, None, 0), (5, "", 0), (6, "alpha alpha beta gamma", 0),
    (1, "xx ONE two,  three four five six seven eight nine ten yy", 0), (7, "two three four five six seven eight nine ten eleven " * 3000, 0),
]


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [50_000, 1])
def test_leaks(spark, limit):
    again = " ".join("wow such a long line of words that comes again".split())
    docs, items = frames(spark, [*DOCS, (8, again, 0)], [*ITEMS, (6, f"{again}, {again}"), (None, again)])
    got = {(r.doc_id, r.item_id): r.n_windows for r in leakage.find_leaks(docs, items, max_broadcast_words=limit).collect()}
    assert got == {(1, 1): 2, (1, 5): 2, (3, 2): 1, (7, 1): 3000, (8, 6): 1}
    assert leakage.find_leaks(docs.limit(0), items).count() == 0 and leakage.find_leaks(docs, items.limit(0)).count() == 0


def test_leaks_against_brute_force(spark):
    words = ["a", "b", "c", "Ä"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    docs, items = frames(spark, [(i, t, 0) for i, t in enumerate(texts[:80])], list(enumerate(texts[80:])))

    def grams(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    expected = {(i, j) for i, t in enumerate(texts[:80]) for j, u in enumerate(texts[80:]) if grams(t) & grams(u)}
    got = leakage.find_leaks(docs, items, n=5)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == expected


@pytest.mark.parametrize("limit", [50_000, 1])
def test_leaks_are_cut_out(spark, limit):
    docs, items = frames(spark, [*DOCS, (9, "KEEP THIS İ Case İstanbul, ONE two three four five six seven eight nine ten; and İ THIS", 0), (10, "ALL İ KEPT", 0)])
    rows = leakage.remove_leaks(docs, items, max_broadcast_words=limit).collect()
    assert len(rows) == len(DOCS) + 2
    by = {r.doc_id: r for r in rows}
    assert by[1].text == "xx  yy" and by[2].text == DOCS[1][1] and by[3].text == "" and by[4].text is None and by[6].n_removed == 0
    assert by[9].text == "KEEP THIS İ Case İstanbul,  İ THIS" and by[10].text == "ALL İ KEPT"
    assert leakage.find_leaks(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"), items).count() == 0


# Shared spans


def test_compact_windows_stand_for_every_subsequence_once():
    r = np.random.default_rng(0)
    for _ in range(300):
        n, t = int(r.integers(1, 60)), int(r.integers(1, 20))
        h = r.integers(1, r.choice([3, 10, 1000]), n).astype(np.uint64) << np.uint64(40)
        found = defaultdict(set)
        for left, mid, right in zip(*spans.compact_windows(h, t)):
            assert h[left : right + 1].min() == h[mid]
            for i in range(max(left, mid - t + 1), min(mid, right - t + 1) + 1):
                found[int(i)].add(int(mid))
        assert found == {i: {int(i + np.argmin(h[i : i + t]))} for i in range(n - t + 1)}


def brute(docs, length):
    at = defaultdict(set)
    for d, text in docs:
        for i in range(len(text or "") - length + 1):
            at[text[i : i + length]].add((d, i))
    pairs, places = set(), defaultdict(set)
    for found in at.values():
        ids = sorted({d for d, _ in found})
        pairs |= {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]}
        if len(ids) > 1:
            for d, i in found:
                places[d] |= set(range(i, i + length))
    return pairs, places


def spliced():
    def noise(n):
        return "".join(rng.choice("abcdé 字") for _ in range(n))

    shared = [noise(rng.randint(30, 120)) for _ in range(6)]
    footer = noise(28)
    docs = [(i, "".join(rng.choice([noise(rng.randint(0, 50)), rng.choice(shared)]) for _ in range(rng.randint(0, 6))) + rng.choice(["", footer])) for i in range(60)]
    return [*docs, (60, None), (61, ""), (62, "a" * 500), (63, "a" * 90 + "b"), (64, docs[3][1]), (65, docs[3][1]), (66, "ab" * 200), (67, "ba" * 200)]


@pytest.mark.parametrize(("chunk", "cap", "hashes"), [(1 << 18, 5000, 3), (150, 64, 3), (1 << 18, 2, 3), (150, 2, 1), (1 << 18, 8, 2)])
def test_shared_spans_against_brute_force(spark, chunk, cap, hashes):
    docs = spliced()
    pairs, places = brute(docs, 40)
    assert len(pairs) > 20
    df = spark.createDataFrame([(d, t, 1) for d, t in [*docs, (None, docs[3][1])]], "doc_id long, text string, start int")
    found = spans.shared_passages(df, min_length=40, chunk=chunk, cap=cap, hashes=hashes)
    assert (found[1] is not None) == (cap < 5000)
    texts = dict(docs)
    for r in found[0].collect():
        assert r.doc_a < r.doc_b and r.n_chars >= 40
        assert texts[r.doc_a][r.start_a : r.start_a + r.n_chars] == texts[r.doc_b][r.start_b : r.start_b + r.n_chars]
    assert {tuple(r) for r in spans.shared_pairs(*found).collect()} == pairs
    got = defaultdict(set)
    for r in spans.shared_spans(*found, 40).collect():
        assert not got[r.doc_id] & set(range(r.start, r.start + r.n_chars))
        got[r.doc_id] |= set(range(r.start, r.start + r.n_chars))
    assert {k: v for k, v in got.items() if v} == dict(places)
    parts = {r.doc_id: r for r in spans.shared_parts(df.where("doc_id is not null"), spans.shared_spans(*found, 40)).collect()}
    assert len(parts) == len(docs) and parts[60].share == 0.0 and parts[64].n_shared == len(places[64])


def test_a_standing_footer_makes_no_pairs(spark):
    """A footer a little shorter than a stretch under many texts: crowded, and cut down by the further hashes."""
    own = random.Random(3)
    foot = "".join(own.choice("abcdefgh") for _ in range(38))
    docs = [(i, "".join(own.choice("ijklmnop") for _ in range(60)) + foot) for i in range(300)]
    docs += [(1000 + i, docs[i][1][20:]) for i in range(5)]
    found = spans.shared_passages(spark.createDataFrame(docs, "doc_id long, text string"), min_length=40, cap=16)
    assert {tuple(r) for r in spans.shared_pairs(*found).collect()} == brute(docs, 40)[0]
    assert found[1].count() < 300


def test_rows_of_one_id_are_parts_of_one_document(spark):
    texts = ["".join(rng.choice("abcdef") for _ in range(100)) for _ in range(3)]
    docs = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, "x" + texts[0][10:70]), (3, texts[1][30:80] + "y"), (4, texts[2])]
    found = spans.shared_passages(spark.createDataFrame(docs, "doc_id long, text string"), min_length=40)
    assert {tuple(r) for r in spans.shared_pairs(*found).collect()} == {(1, 2), (1, 3)}


def test_spans_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spans.shared_pairs(*spans.shared_passages(empty)).count() == 0


# Mixing


def test_running_sums(spark):
    rows = [(rng.choice("aab"), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    for group in ("g", None):
        got = {r.o: r.upto for r in mixing.running_sum(df, group, ["o"], "v", "upto").collect()}
        total, expected = defaultdict(int), {}
        for g, o, v in rows:
            total[g if group else ""] += v
            expected[o] = total[g if group else ""]
        assert got == expected


TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("C", 0.1, 2), ("none", 0.1, 2), (None, 0.5, 1), ("zero", 0.0, 1)]


def sources(spark, n=4000):
    rows = [(i, "aAAb"[i % 4] if i % 9 else "c", 5 + i % 7, "x") for i in range(n)] + [(n, None, 5, "x"), (n + 1, "d", 5, "x"), (n + 2, "a", 0, "x"), (n + 3, "a", None, "x")]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, mix_share string")


def test_mix(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix(sources(spark), targets)
    rows = {r.source: r for r in report.collect()}
    assert set(rows) == {"a", "b", "c", "none"}
    for name, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(rows[name].mix_share - share) < 1e-9 and abs(rows[name].reached_share - share) < 0.01
    assert rows["none"].n_tokens == 0
    used = mixture.groupBy("doc_id", "source").agg(F.max("use").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.m == r.n <= {"a": 1, "b": 3, "c": 2}[r.source] for r in used)
    again = {tuple(r) for r in mixing.mix(sources(spark).repartition(5), targets)[0].collect()}
    assert again == {tuple(r) for r in mixture.collect()}


def test_mix_over_and_under_budget(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    _, small = mixing.mix(sources(spark), targets, budget=2000)
    assert 1950 < sum(r.n_tokens for r in small.collect()) <= 2000
    mixture, large = mixing.mix(sources(spark), targets, budget=10**9)
    assert mixture.where("source = 'a'").count() == sources(spark).where("lower(source) = 'a' and n_tokens > 0").count()
    empty, report = mixing.mix(sources(spark).limit(0), targets)
    assert empty.count() == 0 and {r.reached_share for r in report.collect()} == {0.0}


def test_token_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = "/opt/tokenizers/byte_bpe_50k.json"
    try:
        encoder = tokenizers.Tokenizer.from_file(path)
    except Exception:
        pytest.skip("no tokenizer file here")
    encoder.encode_special_tokens = True
    texts = ["", None, "plain words", "é 字 <|endoftext|>", "word " * 50_000, "it's  1234\n\n x", "\x00\ufeff 🎵🎵"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit(-1))
    for file in (path, path.replace(".json", ".tiktoken")):
        got = {r.doc_id: r.n_tokens for r in mixing.count_tokens(df, "text", file).collect()}
        assert got == {i: len(encoder.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
