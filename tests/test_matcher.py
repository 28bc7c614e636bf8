import random

import pytest
from pyspark.sql import functions as F

from cantera.operators import genre, matcher, moods
from cantera.plans import library
from cantera.plans import vocab as V
from tests.slow_matcher import match


def matched(spark, lists, vocabulary, k=3):
    """By expression and by Arrow pass, which have to agree."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, tags array<string>")
    both = matcher.match_lists(df, {"listed": (("tags",), vocabulary)}, k)
    rows = both.select("i", "listed", matcher.match_tags(F.col("tags"), vocabulary, k).alias("m")).orderBy("i").collect()
    assert all(r.m == r.listed for r in rows)
    return [[(m.target, m.raw, round(m.score, 9)) for m in r.m] for r in rows]


FAMILIES = [
    *((t, "Rock") for t in ("math rock", "desert rock", "yacht rock", "space rock jams", "kraut rock", "surf rock")),
    ("polka punk", "Punk"), ("chamber pop", "Pop"), ("sludge metal", "Metal"), ("trap soul", "Hip-Hop"), ("trap soul", "Soul"),
    ("latin jazz", "Jazz"), ("latin jazz", "Latin"), ("boogie blues", "Blues"), ("outlaw country", "Country"), ("freak folk", "Folk"),
    ("minimal techno", "Electronic"), ("dub poetry", "Reggae"), ("space opera", "Classical"),
]


def test_genre_families(spark):
    found = matched(spark, [[t] for t, _ in FAMILIES], matcher.PRIMARY)
    for (tag, target), row in zip(FAMILIES, found):
        names = [m[0] for m in row]
        assert target in names, tag
        if target == "Rock":
            assert names[0] == "Rock"


EXACT = [
    (matcher.PRIMARY, ["math rock"], [("Rock", "math rock", 0.95)]),
    (matcher.PRIMARY, ["ska punk"], [("Punk", "ska punk", 0.95), ("Reggae", "ska punk", 0.95)]),
    (matcher.PRIMARY, ["clubby house"], [("Electronic", "clubby house", 0.95), ("Dance", "clubby house", 0.95)]),
    (matcher.PRIMARY, ["noise", "post punk", "folk metal", "pop"], [("Punk", "post punk", 0.912), ("Pop", "pop", 0.88), ("Folk", "folk metal", 0.874)]),
    (matcher.PRIMARY, ["v", "w", "x", "y", "blues", "soul"], [("Blues", "blues", 0.84)]),
    (matcher.PRIMARY, ["  HIP hop "], [("Hip-Hop", "  HIP hop ", 1.0)]),
    (matcher.SUB, ["shoegaze", "dream pop", "post-punk revival"], [("Shoegaze", "shoegaze", 1.0), ("Punk Rock", "post-punk revival", 0.874)]),
    (matcher.SUB, ["soft rock", "punk rock", "hard rock", "mellow"], [("Soft Rock", "soft rock", 1.0)]),
    (matcher.SUB, ["indie", "dance"], [("Indie Pop", "indie", 0.95), ("Dance-Pop", "dance", 0.912)]),
    (matcher.SUB, ["q1", "q2", "q3", "emo", "funk"], [("Emo", "emo", 0.88), ("Funk", "funk", 0.84)]),
    (matcher.SUB, ["emo", "post-hardcore", "screamo", "drone", "thrash", "ballad"], [("Emo", "emo", 1.0), ("Post-Hardcore", "post-hardcore", 0.96)]),
    (matcher.SUB, ["french"], []),
    (matcher.MOOD_TAGS, ["brooding", "warm", "organic"], [("Brooding", "brooding", 1.0), ("Warm", "warm", 0.96), ("Organic", "organic", 0.92)]),
    (matcher.MOOD_TAGS, ["hang"], [("Chill Hang", "hang", 0.95)]),
    (matcher.MOOD_TAGS, ["club"], [("Electronic", "club", 0.95)]),
]


@pytest.mark.parametrize("vocabulary", [matcher.PRIMARY, matcher.SUB, matcher.MOOD_TAGS])
def test_exact_results(spark, vocabulary):
    cases = [(t, e) for v, t, e in EXACT if v is vocabulary]
    assert matched(spark, [t for t, _ in cases], vocabulary) == [[(a, b, round(c, 9)) for a, b, c in e] for _, e in cases]


STYLES = [
    (["folk"], [], ["Indie Folk", "Folk Rock"]),
    (["melodic thrash"], ["Thrash Metal"], []),
    (["doom metal revival"], [], ["Doom Metal"]),
    (["gangsta hiphop"], ["Rap"], []),
    (["doo-wop", "oldies but goldies", "swing"], ["Oldies"], []),
    (["country", "british invasion"], ["British Invasion"], ["Country Rock"]),
    (["b1", "b2", "b3", "b4", "b5", "thrash"], [], ["Thrash Metal"]),
]


def test_styles(spark):
    for (tags, yes, no), row in zip(STYLES, matched(spark, [t for t, *_ in STYLES], matcher.SUB)):
        names = {m[0] for m in row}
        assert set(yes) <= names and not set(no) & names, tags


def test_random_lists_against_the_slow_matcher(spark):
    pool = [*library.DRAWN, *V.PRIMARY_GENRES, "punk metal", "ROCK", "hip-hop", "rap", "ska", "", "  ", "new  wave", "é", "a-b", "folk rock indie"]
    rng = random.Random(4)
    lists = [[rng.choice(pool) for _ in range(rng.randint(0, 9))] for _ in range(400)]
    for vocabulary in (matcher.PRIMARY, matcher.SUB, matcher.MOODS, matcher.MOOD_TAGS):
        got = matched(spark, lists, vocabulary)
        assert got == [match(t, vocabulary) for t in lists]
        for row in got:
            assert len(row) <= 3 and [m[2] for m in row] == sorted((m[2] for m in row), reverse=True)


def test_null_and_empty_lists(spark):
    assert matched(spark, [None, [], [None, "rock", None]], matcher.PRIMARY) == [[], [], [("Rock", "rock", 1.0)]]


def test_vectors(spark):
    near = {"hushed": [0.6, 0.8, 0.0], "roaring": [0.0, 0.6, 0.8], "nowhere": [0.5, 0.5, 0.5]}
    v = matcher.Vocabulary(("quiet", "plain", "loud"))
    df = spark.createDataFrame(
        [(["hushed"], [near["hushed"]]), (["nowhere", "roaring"], [near["nowhere"], near["roaring"]]), ([], [])],
        "tags array<string>, vecs array<array<float>>",
    )
    targets = F.array(*[F.array(*[F.lit(float(i == k)) for i in range(3)]) for k in range(3)])
    sims = matcher.similarities(F.col("vecs"), targets)
    rows = df.select(
        matcher.best_pair(F.col("tags"), v, sims, 0.75).alias("p"),
        matcher.match_tags(F.col("tags"), v, 3, sims, 0.7).alias("m"),
    ).collect()
    assert rows[0].p.accepted == "plain" and abs(rows[0].p.score - 0.8) < 1e-6 and rows[0].p.raw == "hushed"
    # 0.8 at rank 1 counts 0.76; the middle one is as near to every target, at 0.577 and rank 0
    assert [(m.target, m.raw) for m in rows[1].m] == [("loud", "roaring"), ("quiet", "nowhere"), ("plain", "roaring")]
    assert [(m.target, m.raw) for m in rows[0].m] == [("plain", "hushed"), ("quiet", "hushed")]
    assert (rows[2].p.accepted, rows[2].p.best, rows[2].p.raw, rows[2].p.score, rows[2].m) == (None, None, None, 0.0, [])


def test_vote_prefers_weight_then_score(spark):
    df = spark.createDataFrame(
        [(["indie", "indie rock", "x"],), (["a", "b", "c", "dance club", "rock"],), (["zzz"],), (None,)], "tags array<string>"
    )
    assert [r[0] for r in df.select(genre.primary_genre(F.col("tags"))).collect()] == ["Rock", "Rock", None, None]


def test_styles_fall_back_to_all_tags_and_lift_the_genre(spark):
    df = spark.createDataFrame(
        [(["zzz"], ["zzz", "skate punk"]), ([], ["heavy metal"]), (["rock"], ["rock"]), (None, None), (["grunge"], [])],
        "own array<string>, every array<string>",
    )
    subs = genre.sub_genres(F.col("own"), F.col("every"))
    rows = df.select(subs.alias("s"), genre.elevated(F.lit("Rock"), subs).alias("g")).collect()
    assert rows[0].s[0] == "Skate Punk" and rows[0].g == "Punk"
    assert rows[1].s == ["Heavy Metal"] and rows[1].g == "Metal"
    assert rows[2].s == ["Rockabilly"] and rows[2].g == "Rock"
    assert rows[3].s == [] and rows[4].s == []


def test_seeds(spark):
    df = spark.createDataFrame([(["Hard Rock", "Grunge", "None"],), (["Classic Rock"],), (["Indie Rock"],), (None,)], "s array<string>")
    assert [r[0] for r in df.select(moods.seeded_moods(F.col("s"))).collect()] == [["Heavy", "Dark"], [], ["Chill Hang"], []]
