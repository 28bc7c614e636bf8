"""Gates, mood rules, audio rules, tempo, merges, state, sources, settings."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cantera.operators import audio, gates, merge, moods, state
from cantera.plans import enrich as plan
from cantera.sources import catalog, config, payloads, remote


def lists(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_mood_conflicts(spark):
    given = [
        ["Happy", "Rowdy", "Mellow"], ["Romantic", "Dark", "Upbeat"], ["Groovy", "hardcore"], ["Melancholic", "Happy"],
        ["Meditative", "ROWDY", "Intense"], ["Lively", "Melancholic", "energetic"], ["Atmospheric", "Warm"], [],
    ]
    got = lists(spark, [(m,) for m in given], "m array<string>", moods.without_conflicts(F.col("m")))
    assert got == [["Happy", "Mellow"], ["Dark"], ["hardcore"], ["Melancholic"], ["Meditative", "Intense"], ["energetic"], ["Atmospheric", "Warm"], []]


def test_tempo_bands(spark):
    m = ["energetic", "Lively", "Happy"]
    rows = [(m, b) for b in (None, 109, 110, 129, 130)]
    got = lists(spark, rows, "m array<string>, b int", moods.tempo_checked(F.col("m"), F.col("b")))
    assert got == [m, ["Happy"], ["Lively", "Happy"], ["Lively", "Happy"], ["energetic", "Happy"]]


def test_specific_moods_first(spark):
    got = lists(spark, [(["Lively", "Dark", "energetic", "Calm"],)], "m array<string>", moods.specific_first(F.col("m")))
    assert got == [["Dark", "Calm", "Lively", "energetic"]]


def test_seed_admission(spark):
    top = "array<struct<label:string,score:double>>"
    schema = f"seeds array<string>, text array<string>, audio array<string>, subs array<string>, bpm int, top {top}"
    rows = [
        (["Chill Hang"], [], [], ["Indie Rock"], 100, []),
        (["Chill Hang"], [], [], ["Indie Rock"], 125, []),
        (["Chill Hang"], [], [], ["Grunge"], 100, []),
        (["Chill Hang"], [], [], ["Indie Rock"], None, [("Heavy", 0.08)]),
        (["Heavy", "Dark"], [], [], ["X"], 99, []),
        (["Heavy", "Dark"], [], [], ["X"], 99, [("aggressive", 0.05)]),
        (["Heavy", "Dark"], ["Dark"], ["Calm"], ["X"], None, None),
        (["Heavy"], [], ["Heavy"], ["X"], 130, None),
    ]
    c = F.col
    got = lists(spark, rows, schema, moods.admitted_seeds(c("seeds"), c("text"), c("audio"), c("subs"), c("bpm"), c("top")))
    assert got == [["Chill Hang"], [], [], [], ["Dark"], ["Heavy", "Dark"], ["Dark"], ["Heavy"]]


def test_mood_gate(spark):
    rows = [
        ("dark", "Ye", None, None), ("dark rock", "Ye", None, "genre"), ("darkside", "Darkside", None, "artist"),
        ("dark moon", "The Moon Band", None, "artist"), ("calm sea", "X1", "Sea Songs", "unknown"), ("calm seas", "Q Z", "Seas", "album"),
        ("calm 90s", "Q Z", "", "digit"), ("calm ²", "Q Z", "", "digit"), ("gloop", "Q Z", "", "unknown"),
        ("acoustic", "Q Z", "", "boilerplate"), ("dark", "", None, "artist"), ("dark", None, None, "artist"), ("", "Q Z", None, "artist"),
    ]
    got = lists(spark, [r[:3] for r in rows], "t string, a string, b string", gates.mood_tag_reason(F.col("t"), F.col("a"), F.col("b")))
    assert got[4] in ("unknown", None)  # "sea" is too short to name the album
    assert [g for i, g in enumerate(got) if i != 4] == [r[3] for i, r in enumerate(rows) if i != 4]


def test_artist_identity(spark):
    rows = [
        ("Ye", "Ye", True), ("Ye", "Ye feat. Jay-Z", True), ("Ye", "Yes", False), ("Air", "Air Supply", False),
        ("The Beatles", "Beatles", True), ("Beatles", "the beatles ", True), ("Ye feat. X", "Ye", False), ("", "X", True), (None, "X", True),
    ]
    got = lists(spark, [r[:2] for r in rows], "e string, c string", gates.same_artist(F.col("e"), F.col("c")))
    assert got == [r[2] for r in rows]


def test_confidence_gate(spark):
    scores = [0.049, 0.05, 0.08, 0.099, 0.10, 0.159, 0.16]
    tops = [([("dark", s), ("zzz", 0.2)],) for s in scores] + [([("love", s), ("zzz", 0.2)],) for s in scores]
    tops += [([("odd", s)],) for s in scores] + [([("melodic", 0.15), ("film", 0.9)],), (None,)]
    got = lists(spark, tops, "t array<struct<label:string,score:double>>", F.transform(audio.confident(F.col("t")), lambda p: p["label"]))
    assert ["dark" in g for g in got[:7]] == [False, True, True, True, True, True, True]
    assert ["love" in g for g in got[7:14]] == [False, True, True, True, True, True, True]  # love stands for a wanted mood
    assert [g == ["odd"] for g in got[14:21]] == [False, False, True, True, True, True, True]
    assert got[21:] == [[], []]


def test_audio_moods(spark):
    schema = "t array<struct<label:string,score:double>>, b int"
    rows = [([("love", 0.3), ("energetic", 0.2)], 100), ([("energetic", 0.2)], 135), ([("calmness", 0.01)], None), (None, None)]
    got = lists(spark, rows, schema, audio.audio_moods(F.col("t"), F.col("b")))
    assert (got[0].moods, got[0].accepted, got[0].score) == (["Romantic"], ["Romantic"], 0.3)
    assert got[1].moods == ["Energetic"]
    assert (got[2].moods, got[2].accepted) == (["calm"], [])
    assert (got[3].moods, got[3].score) == ([], 0.0)


def test_audio_genres(spark):
    rows = [([("Rock---Punk Rock", 0.5), ("Folk, World---Grunge", 0.2), ("Jazz", 0.09)],), ([],), (None,)]
    got = lists(spark, rows, "t array<struct<label:string,score:double>>", audio.audio_genres(F.col("t")))
    assert got[0].genre == "Punk" and "Punk Rock" in got[0].sub_genres
    assert got[1].genre is None and got[1].sub_genres == [] and got[2].genre is None


def test_inference_plug_in(spark, tmp_path):
    class Model:
        labels = ["a", "b"]

        def frames(self, content):
            if not content:
                raise ValueError("nothing to hear")
            return [[1.0, 0.0], [0.5, 0.5]]

    (tmp_path / "one.mp3").write_bytes(b"x")
    (tmp_path / "two.mp3").write_bytes(b"")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    means = audio.pooled(audio.infer(files, Model()), "key", "scores")
    top = audio.top_labels(audio.top_classes(means, "key"), "key", Model.labels).collect()
    assert len(top) == 1 and [(p.label, p.score) for p in top[0].top] == [("a", 0.75), ("b", 0.25)]


def test_tempo_rounding(spark):
    rows = [(x,) for x in (120.4, 135.6, 120.5, 121.5, 0.2, -3.0, None, float("nan"))]
    assert lists(spark, rows, "x double", audio.whole_bpm(F.col("x"))) == [120, 136, 120, 122, None, None, None, None]


def test_file_merges(spark):
    schema = "p string, e map<string,array<string>>, g array<string>, m array<string>, b int, o boolean"
    rows = [
        ("song.mp3", {}, ["Rock", "Grunge"], ["Energetic"], 120, False),
        ("song.flac", {"genre": ["Old"]}, ["New"], [], None, False),
        ("song.flac", {"genre": ["Old"]}, ["New"], [], None, True),
        ("song.wav", {}, ["New"], [], None, True),
        (None, None, ["New"], None, None, None),
        ("a.M4A", None, None, ["Lively"], 110, None),
    ]
    c = [F.col(x) for x in "pegmbo"]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(merge.file_modified(*c)).collect()] == [True, False, True, False, False, True]
    frames = [{w.frame: w["values"] for w in r[0]} for r in df.select(merge.frame_writes(c[0], F.lit(None).cast("map<string,array<string>>"), *c[2:])).collect()]
    assert frames[0] == {"TCON": ["Rock", "Grunge"], "TMOO": ["Energetic"], "TXXX:MOOD": ["Energetic"], "TBPM": ["120"]}
    assert frames[5] == {"----:com.apple.iTunes:mood": ["Lively"], "tmpo": ["110"]}
    assert frames[3] == {} and frames[4] == {}


def test_state_store(spark, tmp_path):
    store = state.StateStore(spark, str(tmp_path / "state"))
    assert store.read().count() == 0 and store.stats().first() == (0, 0, 0)

    def batch(*rows):
        return spark.createDataFrame([(k, "t", "a", m, 1.0, "hybrid", datetime(2024, 1, 1, 0, 0, s)) for k, m, s in rows], state.STATE)

    store.save(batch(("1", "calm", 1), ("1", "dark", 2), ("2", None, 1)))
    store.save(batch(("2", "happy", 3), ("3", None, 3)))
    store.save(batch())
    assert {(r.rating_key, r.mapped_mood) for r in store.read().collect()} == {("1", "dark"), ("2", "happy"), ("3", None)}
    assert tuple(store.stats().first()) == (3, 2, 1)
    assert store.is_processed("3") and not store.is_processed("4") and store.versions() == [1, 2, 3]
    tracks = spark.createDataFrame([("1",), ("4",)], "rating_key string")
    assert [r[0] for r in gates.unprocessed(tracks, store.read()).collect()] == ["4"]
    assert gates.unprocessed(tracks, store.read(), overwrite=True).count() == 2


def test_page_tags(spark):
    page = '<a href="/tag/indie+rock">x</a> <a href="/tag/post-punk/top">y</a> /tag/Indie%20Rock?x /tag/50%25+off /tag/50% /tag/a%2Bb'
    got = lists(spark, [(page,), (None,), ("",)], "h string", payloads.page_tags(F.col("h")))
    assert got == [["indie rock", "post-punk", "50% off", "50%", "a b"], [], []]


RECORDINGS = """{"recordings": [
 {"artist-credit": [{"name": "Yes"}], "tags": [{"name": "wrong"}]},
 {"artist-credit": [{"name": "Ye", "artist": {"name": "Ye", "tags": [{"name": "rap"}]}}], "tags": [{"name": "post-punk", "count": 3}],
  "genres": [{"name": "indie rock"}, {"name": ""}], "releases": [{"release-group": {"genres": [{"name": "rap"}, {"name": "soul"}]}}]}]}"""


def test_answers(spark):
    rows = [(RECORDINGS, "Ye"), ('{"recordings": [{"tags": [{"name": "a"}]}]}', "Z"), ("broken", "Z"), (None, "Z"), ('{"recordings": []}', None)]
    got = lists(spark, rows, "b string, a string", payloads.recording_tags(F.col("b"), F.col("a")))
    assert got == [["post-punk", "indie rock", "rap", "soul"], ["a"], [], [], []]
    rows = [('{"results": [{"genre": ["Rock"], "style": ["Post-Punk", "Rock", "Indie Rock"]}]}',), ('{"results": []}',), (None,)]
    assert lists(spark, rows, "b string", payloads.release_tags(F.col("b"))) == [["Rock", "Post-Punk", "Indie Rock"], [], []]


def test_remote_calls_retry_and_give_up(spark):
    def call(row):
        if row["k"] == "busy":
            raise remote.Busy
        if row["k"] == "bad":
            raise OSError
        return row["k"] * 2

    keys = spark.createDataFrame([("a",), ("a",), ("busy",), ("bad",)], "k string")
    got = dict(remote.fetch(keys, call, spacing=0, retries=1, pause=0).collect())
    assert got == {"a": "aa", "busy": None, "bad": None}


def test_export(spark):
    line = '{"ratingKey": "7", "title": "T", "grandparentTitle": "", "originalTitle": "A", "moods": [{"tag": "Calm"}], "media": [{"parts": [{"file": "/x.mp3"}]}]}'
    parsed = spark.createDataFrame([(line,)], "v string").select(F.from_json("v", catalog.EXPORT).alias("e")).select("e.*")
    assert tuple(catalog.from_export(parsed).first()) == ("7", "T", "A", "", "/x.mp3", ["Calm"])


def test_paths_files_and_limits(spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"1")
    tracks = spark.createDataFrame([(1, f"{tmp_path}/a.mp3"), (2, f"{tmp_path}/b.mp3"), (3, ""), (4, None)], "rating_key int, path string")
    here, gone = gates.present(tracks, catalog.file_listing(spark, str(tmp_path)))
    assert {r[0] for r in here.collect()} == {1} and {r[0] for r in gone.collect()} == {2, 3, 4}
    got = lists(spark, [("/a/b",), ("/b/a",), (None,), ("",)], "p string", gates.remapped(F.col("p"), "/a", "/c"))
    assert got == ["/c/b", "/b/a", None, ""]
    assert [r[0] for r in gates.chosen(tracks, 2).collect()] == [1, 2]
    assert gates.chosen(tracks, 3, seed=1).count() == 3


def test_settings(tmp_path):
    file = tmp_path / "c.yaml"
    file.write_text("mapping: {threshold: 0.7, target_moods: [calm]}\nprocessing: {batch_size: 5, nonsense: 1}\nother: 3\n")
    got = config.load(str(file), {"CANTERA_PROCESSING_DRY_RUN": "true", "CANTERA_PROCESSING_BATCH_SIZE": "50", "CANTERA_STATE_PATH": "/s"})
    assert (got.mapping.threshold, got.mapping.target_moods, got.processing.batch_size) == (0.7, ("calm",), 50)
    assert got.processing.dry_run is True and got.state.path == "/s" and got.audio.threshold == 0.1
    assert config.load(None, {}) == config.Settings()
    config.save({"tags": {"api_key": "k"}, "processing": {"batch_size": 9}}, str(file))
    assert config.load(str(file), {}).processing.batch_size == 9 and config.load(str(file), {}).mapping.threshold == 0.7
    assert config.masked("abcdefghijkl") == "abcd…ijkl" and config.masked("abc") == "***"


@pytest.fixture(scope="module")
def enriched(spark):
    rows = [
        ("1", "T", "Quell", "Z", ["calm"], ["indie rock", "mellow"], ["indie rock", "mellow", "rock"], 90.0),
        ("2", "T", "Quell", None, [], ["punk rock", "aggressive"], ["punk rock", "aggressive"], 150.0),
        ("3", "T", "Quell", None, None, [], [], None),
    ]
    schema = ("rating_key string, title string, artist string, album string, current_moods array<string>, specific_tags array<string>, "
              "all_tags array<string>, raw_bpm double")  # fmt: skip
    return plan.enrich(spark.createDataFrame(rows, schema)).cache()


def test_plan(enriched):
    rows = {r.rating_key: r for r in enriched.collect()}
    assert rows["1"].genre == "Rock" and rows["1"].sub_genres[0] == "Indie Rock" and "mellow" in rows["1"].moods and rows["1"].bpm == 90
    assert rows["2"].genre == "Punk" and "Rowdy" in rows["2"].moods
    assert rows["3"].genre is None and rows["3"].moods == [] and rows["3"].confidence == 0.0
    assert tuple(plan.run_summary(enriched).first()) == (3, 2, 1, 2, 2, 2, 2)
    assert plan.report(enriched).where("rating_key = '3'").first().moods_after == "(None)"
    assert plan.results(enriched, F.lit(datetime(2024, 1, 1, 1, 2, 3, 456))).first().processed_at == datetime(2024, 1, 1, 1, 2, 3)


def test_features(spark):
    assert plan.Features.chosen() == plan.Features() and plan.Features.chosen(mood=True) == plan.Features(False, False, True, False)
    df = spark.createDataFrame([("a", "b", None, ["rock"], ["rock"])], "artist string, title string, album string, specific_tags array<string>, all_tags array<string>")
    row = plan.enrich(df, plan.Features.chosen(genre=True), raw_bpm=None).first()
    assert (row.genre, row.sub_genres, row.moods, row.bpm) == ("Rock", [], [], None)
