from datetime import datetime
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from cantera import cli
from cantera.operators.state import ORDER, STATE, StateStore
from cantera.plans import enrich as plan
from cantera.sources import config
from cantera.streaming.enrich import enrich_stream, newest_only, upsert_into

SCHEMA = ("rating_key string, title string, artist string, album string, specific_tags array<string>, all_tags array<string>, "
          "raw_bpm double, scanned_at timestamp_ntz")  # fmt: skip


def rows(*keys, tag="punk rock"):
    return [(k, f"t{k}", "Quell", None, [tag], [tag], 120.0, datetime(2024, 1, 1, 0, 0, int(k))) for k in keys]


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(str(folder))


def test_stream_into_the_store(spark, tmp_path):
    data, store = tmp_path / "data", StateStore(spark, str(tmp_path / "state"))
    for batch in (rows("1", "2"), rows("2", "3", tag="calm")):
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(str(data))
        query = stream(spark, data).writeStream.foreachBatch(upsert_into(store)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {(r.rating_key, r.mapped_mood) for r in store.read().collect()} == {("1", "Rowdy"), ("2", "Rowdy"), ("3", "calm")}


def test_stream_and_batch_agree(spark, tmp_path):
    spark.createDataFrame(rows("1", "2", "3"), SCHEMA).write.parquet(str(tmp_path / "data"))
    columns = ["rating_key", "genre", F.array_join("moods", "|").alias("moods")]
    unique = newest_only(stream(spark, tmp_path / "data"), "scanned_at", "1 hour", ["rating_key"])
    query = enrich_stream(unique).select(*columns).writeStream.format("memory").queryName("enriched").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = plan.enrich(spark.read.parquet(str(tmp_path / "data"))).select(*columns)
    assert sorted(map(tuple, spark.table("enriched").collect())) == sorted(map(tuple, batch.collect()))


def test_commands(spark, tmp_path, capsys):
    tracks = spark.createDataFrame([(str(i), f"t{i}", "Quell" if i % 2 else "Other", ["punk rock"]) for i in range(6)], "rating_key string, title string, artist string, raw_tags array<string>")
    tracks.write.parquet(str(tmp_path / "tracks"))
    base = ["--state", str(tmp_path / "state")]
    assert cli.main(["enrich", "--catalog", str(tmp_path / "tracks"), *base, "--artist", "QUELL", "--dry-run"], spark) == 0
    assert StateStore(spark, str(tmp_path / "state")).read().count() == 0
    assert cli.main(["enrich", "--catalog", str(tmp_path / "tracks"), *base, "--limit", "4", "--output", str(tmp_path / "out")], spark) == 0
    assert cli.main(["analyze", "--catalog", str(tmp_path / "tracks"), *base, "--verbose", "--genre"], spark) == 0
    assert cli.main(["status", *base], spark) == 0
    assert StateStore(spark, str(tmp_path / "state")).stats().first().total_processed == 6
    assert cli.main(["setup", "--config", str(tmp_path / "c.yaml"), "--set", "processing.batch_size=7"], spark) == 0
    assert "batch_size: 7" in (tmp_path / "c.yaml").read_text()
    assert "total_processed" in capsys.readouterr().out


def library(spark, folder, keys, tags=("punk rock",), **more):
    df = spark.createDataFrame([(str(k), f"t{k}", "Quell", "Album", f"/music/{k}.mp3", list(tags)) for k in keys],
                               "rating_key string, title string, artist string, album string, file_path string, raw_tags array<string>")
    df.withColumns(more).write.mode("overwrite").parquet(str(folder))
    return str(folder)


def test_two_runs_keep_what_the_first_wrote(spark, tmp_path):
    args = ["--state", str(tmp_path / "state"), "--output", str(tmp_path / "out")]
    for n in (3, 5):
        assert cli.main(["enrich", "--catalog", library(spark, tmp_path / f"t{n}", range(n)), *args], spark) == 0
        assert {r.rating_key for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {str(k) for k in range(n)}
    assert cli.main(["enrich", "--catalog", str(tmp_path / "t5"), *args], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_a_run_that_breaks_off_keeps_its_batches(spark, tmp_path, monkeypatch):
    args = ["enrich", "--catalog", library(spark, tmp_path / "t", range(40)), "--state", str(tmp_path / "state"), "--output", str(tmp_path / "out"), "-b", "10"]
    saved, save = [], StateStore.save

    def breaks(self, *a, **k):
        if len(saved) == 2:
            raise RuntimeError("lost")
        saved.append(save(self, *a, **k))

    monkeypatch.setattr(StateStore, "save", breaks)
    with pytest.raises(RuntimeError):
        cli.main(args, spark)
    store = StateStore(spark, str(tmp_path / "state"))
    assert 0 < store.read().count() < 40
    monkeypatch.setattr(StateStore, "save", save)
    assert cli.main(args, spark) == 0
    assert store.read().count() == 40
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("rating_key").distinct().count() == 40


def test_only_empty_fields_are_written(spark, tmp_path):
    catalog = library(spark, tmp_path / "t", range(2))
    held = spark.createDataFrame([("/music/0.mp3", {"genre": ["Jazz"]}), ("/music/1.mp3", {})], "file_path string, existing map<string,array<string>>")
    held.write.parquet(str(tmp_path / "held"))
    args = ["enrich", "--catalog", catalog, "--state", str(tmp_path / "state"), "--output", str(tmp_path / "out"), "--write-tags"]
    with pytest.raises(SystemExit):
        cli.main(args, spark)
    assert cli.main([*args, "--existing", str(tmp_path / "held"), "--sync"], spark) == 0
    out = {r.rating_key: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert "TCON" not in {w.frame for w in out["0"].writes} and "TCON" in {w.frame for w in out["1"].writes}
    assert out["0"].edits.add_genres == out["0"].genres and out["0"].edits.lock_moods


def test_tag_sources_and_predictions(spark, tmp_path):
    catalog = library(spark, tmp_path / "t", range(3), tags=())
    spark.createDataFrame([("track", "QUELL ", "t0", ["jazz"]), ("album", "Quell", "Album", ["blues"]), ("artist", "quell", None, ["folk"]),
                           ("release", "Quell", "t1", ["techno"])], "kind string, artist string, name string, tags array<string>").write.parquet(str(tmp_path / "s"))
    heard = [("2", [("sad", 0.9)], None), ("2", [("sad", 0.9)], None)]
    kind = "array<struct<label:string,score:double>>"
    spark.createDataFrame(heard, f"rating_key string, mood_top {kind}, genre_top {kind}").write.parquet(str(tmp_path / "p"))
    (tmp_path / "c.yaml").write_text("releases: {api_token: x}\ncommand: {enabled: true, binary_path: tagger}\n")
    assert cli.main(["enrich", "--catalog", catalog, "--state", str(tmp_path / "state"), "--output", str(tmp_path / "out"), "--config", str(tmp_path / "c.yaml"),
                     "--sources", str(tmp_path / "s"), "--predictions", str(tmp_path / "p")], spark) == 0
    out = {r.rating_key: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out["0"].all_tags == ["jazz", "blues", "folk"] and out["0"].specific_tags == ["jazz"] and out["0"].genre == "Jazz"
    assert out["1"].all_tags == ["blues", "folk", "techno"] and out["2"].moods == ["Melancholic"]
    assert out["2"].command == ["tagger", "modify", "-y", "path:/music/2.mp3", "mood=Melancholic"]


def test_the_last_row_of_a_key_is_the_same_in_any_order(spark, tmp_path):
    rows = [("k", "t", "a", f"m{i}", 1.0, "hybrid", datetime(2024, 1, 1)) for i in range(4)]
    kept = set()
    for i, order in enumerate(list(permutations(rows))[::7]):
        store = StateStore(spark, str(tmp_path / str(i)))
        store.save(spark.createDataFrame(order, STATE).repartition(3))
        kept.add(store.read().first().mapped_mood)
    assert kept == {"m3"} and len(ORDER) == 6


def test_batches_of_the_state(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"), most=3)

    def row(key, mood, day):
        return (key, "t", "a", mood, 1.0, "hybrid", datetime(2024, 1, day))

    for i in range(1, 8):
        store.save(spark.createDataFrame([row("same", f"m{i}", 9 - i), row(f"k{i}", None, i)], STATE))
        assert len(store._folders()[1]) <= 3
    got = {r.rating_key: r.mapped_mood for r in store.read().collect()}
    assert got == {"same": "m7", **{f"k{i}": None for i in range(1, 8)}} and store.is_processed("k1") and not store.is_processed("k9")
    (tmp_path / "s" / "_lost").mkdir()
    assert store.next_version() == 8 and store.stats().first().total_processed == 8


def test_wizard(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("tags: {api_key: abcdefghijkl}\nother: 1\n")
    asked = []
    replies = iter(["", "Mine", "", "many", "7", "", "", "", "sad,  calm"])
    config.wizard(str(path), lambda q: asked.append(q) or next(replies))
    settings = config.load(str(path), {})
    assert settings.catalog.library_name == "Mine" and settings.tags.api_key == "abcdefghijkl" and settings.processing.batch_size == 7
    assert settings.mapping.target_moods == ("sad", "calm") and "other: 1" in path.read_text()
    assert "abcd…ijkl" in asked[2] and not any("abcdefghijkl" in q for q in asked)
