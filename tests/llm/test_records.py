"""Reference lists, names, term counts, formatting duplicates, co-occurrence."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations
from math import log

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cantera.llm import canon, cooccurrence, formatting, frequency, names

rng = random.Random(11)

# Reference lists

ENTRIES = [(1, "genre", "copper punk"), (2, "genre", "paper folk"), (3, "genre", "paper soul"), (4, "genre", "fjord-side waltz"), (5, "mood", "weightless"),
           (6, "mood", "sunlit"), (7, "mood", None), (None, "mood", "lost")]
TYPED = [
    ("COPPER  punk", 1), ("*copper-punk!!", 1), ("coper punk", 1), ("copepr punk", 1), ("punk, copper", 1), ("punk (copper)", 1), ("copperpunk", 1),
    ("cppr punk", 1), ("copp. punk", 1), ("genre: copper punk", 1), ("copper punk vibes", 1), ("copper punkish", 1), ("còppér punk", 1), ("ｃｏｐｐｅｒ punk", 1),
    ("best paper folk", 2), ("pure paper soul", 3), ("best paper soul", 3), ("best weightless", 5), ("sunlit vibes", 6), ("weightless vibes", 5), ("pure sunlit", 6),
    ("pure copper punk", 1), ("genre: sunlit", 6), ("genre paper soul", 3), ("sunlitish", 6), ("weightless-ish", 5), ("best copper punk vibes", 1), ("lost copper punk", -1), ("fjord side waltz", 4), ("fjor waltz", 4), ("weíghtless", 5), ("wieghtless", 5), ("wghtlss", 5), ("sunlti", 6),
    ("paper", -1), ("paper punk", -1), ("copper soul", -1), ("copper museum", -1), ("not really folk at all", -1), ("", -1), ("???", -1), ("lost", -1),
    ("x" * 100_000, -1), ("paper fool", -1),
]


def mapped(spark, typed, entries=ENTRIES, field="any", **more):
    values = spark.createDataFrame([(field, v) for v in typed], "field string, value string")
    table = spark.createDataFrame(entries, "entry_id int, kind string, label string").withColumn("value", F.lit(1))
    return {r.value: r.entry_id for r in canon.map_values(values, table, **more).collect()}


def test_typed_values(spark):
    got = mapped(spark, [t for t, _ in TYPED[:-1]] + [None, "sunlit", "sunlit"])
    assert got == {**dict(TYPED[:-1]), "sunlit": 6}
    assert mapped(spark, ["coper punk", "sunlti"], max_broadcast_segments=1) == {"coper punk": 1, "sunlti": 6}
    assert mapped(spark, ["coper punk", "sunlti"], field="mood") == {"coper punk": -1, "sunlti": 6}
    assert mapped(spark, ["coper punk"], entries=[]) == {"coper punk": -1} and mapped(spark, []) == {}


def test_equally_near_entries_are_none(spark):
    assert mapped(spark, ["paper fooul"], [(1, "genre", "paper foul"), (2, "genre", "paper fool")]) == {"paper fooul": -1}


def test_short_labels_and_other_scripts(spark):
    entries = [(1, "genre", "R&B"), (2, "genre", "Рок"), (3, "genre", "演歌"), (4, "genre", "Йодль"), (5, "genre", "U")]
    typed = {"R & B": 1, "r&b": 1, "rb": 1, "rc": -1, "РОК": 2, "рок!": 2, "演歌 ": 3, "Йодль": 4, "йодл": 4, "u.": 5, "演": -1}
    assert mapped(spark, list(typed), entries) == typed


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_the_pigeonhole_join_misses_nothing(spark):
    """Against all pairs: whatever is within a form's errors is met."""
    labels = ["".join(rng.choice("abcd") for _ in range(rng.randint(5, 14))) for _ in range(25)]
    typed = set()
    for label in labels * 8:
        t = list(label)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "x"])
        typed.add("".join(t))
    typed = sorted(t for t in typed if len(t) > 2)
    entries = spark.createDataFrame([(i, "genre", x) for i, x in enumerate(labels)], "entry_id int, kind string, label string")
    parts = spark.sql(canon.PARTS_SQL, entries=entries)
    forms = spark.sql(canon.FORMS_SQL, parts=parts, short=spark.sql(canon.SHORT_SQL, parts=parts))
    segments = spark.sql(canon.SEGMENTS_SQL, forms=forms)
    words = spark.createDataFrame([(t,) for t in typed], "typed string")
    pieces = spark.sql(canon.PIECES_SQL, spread=spark.sql(canon.SPREAD_SQL, typed=words), layout=spark.sql(canon.LAYOUT_SQL, segments=segments))
    got = {(r.typed, r.entry_id, r["rank"], r.d) for r in spark.sql(canon.MATCH_SQL, pieces=pieces, segments=segments).collect()}
    expected = {(t, f.entry_id, f["rank"], d) for f in forms.collect() for t in typed if (d := edits(t, f.form)) <= f.k}
    assert got == expected and len(got) > 100


def test_places_of_typed_values(spark):
    tracks = spark.createDataFrame([(1, ["copper punk", None, "coper punk"]), (2, None), (3, []), (4, ["zzz", "zzz"])], "row_id long, raw_tags array<string>")
    tracks = tracks.withColumns({"value": F.lit(1), "pos": F.lit(2), "label": F.lit("x")})
    results = spark.createDataFrame([(9, "sunlti"), (8, None), (7, "coper punk"), (6, "sunlit")], "result_id long, mapped_mood string")
    entries = spark.createDataFrame(ENTRIES, "entry_id int, kind string, label string")
    got = {tuple(r) for r in canon.map_tags_and_moods(tracks, results, entries).collect()}
    assert got == {("raw_tags", 1, 2, 1), ("raw_tags", 4, 0, -1), ("raw_tags", 4, 1, -1), ("mapped_mood", 9, 0, 6), ("mapped_mood", 7, 0, -1)}


# Names


def subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_subsequences():
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert names.common_subsequence(a, b) == subsequence(a, b)


PEOPLE = [
    ["Marolin Tavekrosto", "MAROLIN TAVEKROSTO", "Tavekrosto, Marolin", "M. Tavekrosto", "M Tavekrosto", "Tavekrosto, M.", "Maro Tavekrosto", "Mary Tavekrosto",
     "Marolin Tavekosto", "Marolin Tavekrotso", "Marloin Tavekrosto", 'Marolin "Slow" Tavekrosto', "Marolin J. Tavekrosto", "MarolinTavekrosto",
     "Marolin-Tavekrosto", "Marolin Tavekrosto feat. Bodin Hulegast", "Marolin Tavekrosto (with Someone Else)", "Маrоlin Tavekrosto"],
    ["Marolin Bixunevo", "Bixunevo, Marolin", "M. Bixunevo"], ["Marolin Pedagrusti"], ["Bodin Hulegast", "Bodin Hulegsat"],
    ["Zuvekalor Lantern Quartet", "The Zuvekalor Lantern Quartet", "Zuvekalor Lantern Qt.", "Zuvekalor L. Quartet", "Quartet Zuvekalor Lantern", "Zuvekalor Lantern",
     "Lantern Quartet of Zuvekalor", "Lantern Qt. Zuvekalor", "Zuvekolor Lantern Quartet", "Zuvekalor-Lantern Quartet"],
    ["Hosteribak Lantern Quartet"], ["Zuvirostan Harbour Trio", "Zuvirostan Harbour 3io"], ["???"], ["!!!"], [""],
]


def classes(spark, spellings, **more):
    df = spark.createDataFrame([(s, 1) for s in spellings], "artist string, name int")
    return names.spelling_classes(df, **more)


@pytest.mark.parametrize("cap", [40, 2])
def test_names(spark, cap):
    flat = [s for group in PEOPLE for s in group]
    found = classes(spark, [*flat, None, flat[0], flat[0]], cap=cap)
    pairs = {tuple(r) for r in names.spelling_pairs(found).collect()}
    assert pairs == {p for g in PEOPLE for p in combinations(sorted(g), 2)}
    assert found.count() == len(flat)


def test_crowded_endings_lose_no_pair(spark):
    """Against all pairs: whatever is linked and shares an ending is met, however many share it."""
    own = random.Random(5)
    made = {"maira garcia", "maria garcia", "cate garcia", "kate garcia", "garcia", "m garcia", "mgt garcia", "margarita garcia", "mar ia garcia", "mariagarcia"}
    made |= {f"{''.join(own.choice('bdfghjklnprstvwz') for _ in range(6))} garcia" for _ in range(60)}
    for _ in range(150):
        words = [w for w in own.choice([["marolin", "garcia"], ["garcia", "lantern", "quartet"], ["ensemble", "bortolomeinski"], ["zoe", "garcia"]])]
        for _ in range(own.randint(0, 3)):
            at = own.randrange(len(words))
            i = own.randrange(len(words[at]) + 1)
            words[at] = words[at][:i] + own.choice(["", " ", "a", "m"]) + words[at][i + own.randint(0, 1) :]
        own.shuffle(words)
        made.add(" ".join(" ".join(words).split()))
    made = sorted(made)
    got = {tuple(r) for r in names.candidate_pairs(spark.createDataFrame([(n, n.split()) for n in made], "name string, words array<string>")).collect()}
    ends = {n: {w[-4:] for w in n.split() if len(w) >= 4} for n in made}
    linked = {(a, b) for a, b in combinations(made, 2) if ends[a] & ends[b] and names.same_name(a, b)[0]}
    assert ("maira garcia", "maria garcia") in linked and not linked - got
    assert len(got) < len(made) * (len(made) - 1) / 4


def met(spark, made):
    rows = spark.createDataFrame([(n, n.split()) for n in made], "name string, words array<string>")
    return {tuple(r) for r in names.candidate_pairs(rows).collect()}


def test_names_on_frequent_words_meet_in_proportion(spark):
    """Names that differ in one word of three, and initials of it, among others on the same two."""
    own = random.Random(9)
    groups = {"".join(own.choice(x) for x in ("bdfgklmnprstvz", "aeiou") * 5) for _ in range(400)}
    made = sorted({n for i, g in enumerate(sorted(groups)) for n in (f"{g} lantern quartet", *[f"{g} {g[0]} quartet", f"{g[:4]}{g[5:]} lantern quartet"][: i % 3])})
    got = met(spark, made)
    assert len(got) < 20 * len(made)
    linked = {(a, b) for a, b in combinations(made, 2) if a[-4:] == b[-4:] and names.same_name(a, b)[0]}
    assert linked <= got and len(linked) > 100


def test_crowded_names_of_many_words_lose_no_pair(spark):
    """Against all pairs, with words mistyped beyond likeness, joined, cut to an initial or left out."""
    own = random.Random(6)
    made = {"bo lantern quartet", "xy lantern quartet", "hosteribak lantern kwrtt", "bora bora trio", "bora boda trio", "b bora trio"}
    names_of = ["marolin jotun lantern quartet", "hosteribak lantern quartet", "bora bora lantern quartet", "lantern quartet", "io lantern quartet",
                "a b c lantern quartet of seven", "one two three four five lantern quartet", "marolin j lantern quartet"]
    for _ in range(260):
        words = own.choice(names_of).split()
        for _ in range(own.randint(0, 3)):
            at = own.randrange(len(words))
            i = own.randrange(len(words[at]) + 1)
            kind = own.randrange(6)
            if kind == 0 and at:
                words[at - 1 : at + 1] = [words[at - 1] + words[at]]
            elif kind == 1:
                words[at] = words[at][0]
            elif kind == 2 and len(words) > 2:
                del words[at]
            else:
                words[at] = words[at][:i] + own.choice(["", "a", "mo"]) + words[at][i + own.randint(0, 2) :] or "m"
        if own.random() < 0.3:
            own.shuffle(words)
        made.add(" ".join(words))
    made = sorted(made)
    ends = {n: {w[-4:] for w in n.split() if len(w) > 1} for n in made}
    linked = {(a, b) for a, b in combinations(made, 2) if ends[a] & ends[b] and names.same_name(a, b)[0]}
    assert not linked - met(spark, made) and len(linked) > 1000


def test_rests_of_nearly_alike_names_have_a_key_in_common():
    own = random.Random(8)
    for _ in range(4000):
        a, b = ("".join(own.choice("abc") for _ in range(own.randint(1, 17))) for _ in range(2))
        if own.random() < 0.6:
            i = own.randrange(len(a) + 1)
            b = a[:i] + own.choice(["", "x", "yz"]) + a[i + own.randint(0, 3) :] or "b"
        more = own.randint(2, 30)
        if 2 * (names.common_subsequence(a, b) + more) >= 0.9 * (len(a) + len(b) + 2 * more):
            assert names._nearly_keys(a, len(a) + more) & names._nearly_keys(b, len(b) + more), (a, b, more)


def test_names_of_short_words(spark):
    groups = [["Kate Bush", "Bush, Kate", "K. Bush", "Kate Bsuh", "Kate M. Bush"], ["Nick Cave", "Cave, Nick"], ["Jay Z", "Z, Jay"], ["Max Roy", "Roy, Max", "M. Roy"],
              ["Kyle Rush"], ["Rush"], ["Bush"], ["K. Fox"], ["Kate Fox"], ["Kyle Fox"]]
    for cap in (40, 1):
        found = classes(spark, [s for g in groups for s in g], cap=cap)
        assert {tuple(r) for r in names.spelling_pairs(found).collect()} == {p for g in groups for p in combinations(sorted(g), 2)}


def test_ambiguous_short_forms_link_nobody(spark):
    got = classes(spark, ["Marolin Tavekrosto", "Moberust Tavekrosto", "M. Tavekrosto"])
    assert len({r.label for r in got.collect()}) == 3


def test_no_names_and_long_names(spark):
    assert classes(spark, []).count() == 0
    long = "ab cdefgh " * 2000
    assert len({r.label for r in classes(spark, [long, long.upper(), "other"]).collect()}) == 2


def test_chains_come_together(spark):
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(60)], "name string")
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(49)], "a string, b string")
    got = {r.name: r.label for r in names.components(nodes, edges).collect()}
    assert all(got[f"n{i:03}"] == ("n000" if i < 50 else f"n{i:03}") for i in range(60))


# Term counts

BASKETS = [["a", "b", "a", None], ["a"], None, [], ["c", "", ""], ["b", "a", "a"], ["x"] * 5000]


def test_term_counts(spark):
    df = spark.createDataFrame([(b, 1) for b in BASKETS], "tags array<string>, n int")
    got = {r.term: (r.n_occurrences, r.n_records) for r in frequency.term_frequencies(df, "tags").collect()}
    assert got == {"a": (5, 3), "b": (2, 2), "c": (1, 1), "": (2, 1), "x": (5000, 1)}
    total = df.agg(F.count(F.lit(1)).alias("n_total"))
    marks = {r.term: r.verdict for r in frequency.mark_frequency(frequency.term_frequencies(df, "tags"), total, 1, 1 / 3).collect()}
    assert marks == {"a": "common", "b": "useful", "c": "rare", "": "rare", "x": "rare"}
    assert frequency.term_frequencies(df.limit(0), "tags").count() == 0


def test_shares_are_compared_exactly(spark):
    counts = spark.createDataFrame([("a", 55), ("b", 60), ("c", 61)], "term string, n_records long")
    total = spark.createDataFrame([(100,)], "n_total long")
    for share in (0.6, Fraction(3, 5)):
        marks = {r.term: r.verdict for r in frequency.mark_frequency(counts, total, 2, share).collect()}
        assert marks == {"a": "useful", "b": "useful", "c": "common"}
    large = spark.createDataFrame([("a", 4 * 10**17)], "term string, n_records long")
    assert frequency.mark_frequency(large, spark.createDataFrame([(10**18,)], "n_total long"), 2, 0.3).first().verdict == "common"


# Formatting duplicates


def canonical(tags):
    return tuple(sorted("~" if t is None else "=" + re.sub(r"[\W_]", "", t.lower()) for t in tags))


def test_formatting_duplicates(spark):
    rows, forms = [], ["Rock-Pop", "rock pop", "ROCKPOP", "rock, pop", "jazz", " Jazz!", "", "?", None]
    for i in range(400):
        tags = [rng.choice(forms) for _ in range(rng.randint(0, 3))]
        rows.append((i, rng.choice(["T", "t", None]), rng.choice(["A", None]), rng.choice([tags, None, tags]), "x"))
    rows += [(1000 + i, "Hot", "A", ["a", "B"] if i % 2 else ["b!", " A"], "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, title string, artist string, tags array<string>, head string").repartition(9)
    groups = defaultdict(list)
    for i, t, a, tags, _ in rows:
        if tags:
            groups[t, a, canonical(tags)].append(i)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        copies, runs = formatting.formatting_runs(df, "row_id", ["title", "artist"], "tags")
        assert Counter(tuple(r) for r in copies.collect()) == Counter((min(g), x) for g in groups.values() for x in g if x != min(g))
        assert {r.row_a: r.n_copies for r in runs.collect()} == {min(g): len(g) for g in groups.values()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_formatting_of_nothing(spark):
    df = spark.createDataFrame([(1, "t", None), (2, "t", [])], "row_id long, title string, tags array<string>")
    copies, runs = formatting.formatting_runs(df, "row_id", ["title"], "tags")
    assert copies.count() == 0 and runs.count() == 0


# Co-occurrence


def g2(ab, a, b, n):
    cells = [(ab, a * b), (a - ab, a * (n - b)), (b - ab, (n - a) * b), (n - a - b + ab, (n - a) * (n - b))]
    return 2 * sum(k * log(k * n / e) for k, e in cells if k)


def together(baskets):
    items, pairs = Counter(), Counter()
    for b in baskets:
        s = sorted({x for x in b or [] if x is not None})
        items.update(s)
        pairs.update(combinations(s, 2))
    return items, pairs


@pytest.mark.parametrize("flush", [1_000_000, 7])
def test_pair_counts(spark, flush):
    baskets = [[rng.choice([*"abcdefgh", None, "é", ""]) for _ in range(rng.randint(0, 9))] for _ in range(500)] + [None, []]
    df = spark.createDataFrame([(b, 1) for b in baskets], "items array<string>, n int")
    _, pairs = together(baskets)
    for keep in (None, pa.array(sorted([*"abc", "é"]))):
        got = {(r.item_a, r.item_b): r.n_ab for r in cooccurrence.pair_counts(df, "items", keep, 3, flush).collect()}
        assert got == {p: n for p, n in pairs.items() if keep is None or set(p) <= set(keep.to_pylist())}


@pytest.mark.parametrize("limit", [1000, 1])
def test_cooccurrence(spark, limit):
    baskets = [["a", "b"]] * 30 + [["a", "c"]] * 5 + [["c", "d", "d"]] * 20 + [["a"]] * 5 + [[]] * 40
    df = spark.createDataFrame([(b, 1) for b in baskets], "items array<string>, lift int")
    items, pairs = together(baskets)
    got = cooccurrence.cooccurrence(df, "items", min_support=0.1, min_lift=1.5, max_broadcast_items=limit).collect()
    n = len(baskets)
    expected = {p for p, c in pairs.items() if c * 10 >= n and c * n >= 1.5 * items[p[0]] * items[p[1]]}
    assert {(r.item_a, r.item_b) for r in got} == expected and expected
    for r in got:
        assert abs(r.llr - g2(r.n_ab, r.n_a, r.n_b, n)) < 1e-6 and abs(r.lift - r.n_ab * n / r.n_a / r.n_b) < 1e-9
    assert cooccurrence.cooccurrence(df.limit(0), "items", 0.1, 1).count() == 0
    sure = cooccurrence.cooccurrence(df, "items", min_llr=20.0, max_broadcast_items=limit).collect()
    assert {(r.item_a, r.item_b) for r in sure} == {p for p, c in pairs.items() if g2(c, items[p[0]], items[p[1]], n) >= 20}


def test_support_is_exact_and_nothing_overflows(spark):
    df = spark.createDataFrame([(["a", "b"],)] * 31 + [([],)] * 69, "items array<string>")
    assert cooccurrence.cooccurrence(df, "items", min_support=0.3).count() == 1
    assert cooccurrence.cooccurrence(df, "items", min_support=0.31).count() == 1
    assert cooccurrence.cooccurrence(df, "items", min_support=0.32).count() == 0
    n = (27 * 10**8, 3 * 10**9, 35 * 10**8, 4 * 10**9)
    row = spark.createDataFrame([n], "ab long, a long, b long, n long").select(cooccurrence.log_likelihood(*map(F.col, ("ab", "a", "b", "n"))).alias("llr"))
    assert row.first().llr == pytest.approx(g2(*n), rel=1e-9)
