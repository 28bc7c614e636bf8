"""Plug-ins: embedders, audio models, tempo detectors, writers."""

import json

import numpy as np
from pyspark.sql import functions as F

import cantera
from cantera.operators import audio, embedding, matcher, sinks
from cantera.plans import enrich as plan

WORDS = {"gloomy": [0.9, 0.1], "sunny": [0.1, 0.9], "rock": [1.0, 0.0]}


class Small:
    def encode(self, texts):
        return np.array([WORDS.get(t, [1.0, 0.0] if t.startswith("sad") else [0.0, 1.0] if t.startswith("glad") else [0.7, 0.7]) for t in texts])


def broken():
    raise OSError("no model here")


TWO = matcher.Vocabulary(("sad", "glad"))


def rows(spark):
    return spark.createDataFrame([(1, ["gloomy"]), (2, ["x", "sunny"]), (3, []), (4, ["rock"]), (5, ["sad"])], "row_id int, tags array<string>")


def matched(df):
    found = matcher.match_tags(F.col("tags"), TWO, similarity=F.col("similarity"), threshold=0.8)
    return {r.row_id: [(m.target, m.raw) for m in r.m] for r in df.select("row_id", found.alias("m")).collect()}


def test_moods_reached_by_vectors(spark):
    got = matched(embedding.with_similarity(rows(spark), "tags", TWO, Small))
    assert got == {1: [("sad", "gloomy")], 2: [("glad", "sunny"), ("sad", "x")], 3: [], 4: [], 5: [("sad", "sad")]}
    assert embedding.target_texts(("sad", "calm"), {"calm": "slow and still"}) == ["sad music", "slow and still"]


def test_without_a_model_only_letters_match(spark):
    assert matched(embedding.with_similarity(rows(spark), "tags", TWO, broken)) == {1: [], 2: [], 3: [], 4: [], 5: [("sad", "sad")]}


def test_enrichment_with_an_embedder(spark):
    tracks = spark.createDataFrame([("Quell", None, ["gloomy"], ["gloomy"])], "artist string, album string, specific_tags array<string>, all_tags array<string>")
    assert plan.enrich(tracks, vocabulary=TWO, raw_bpm=None).first().moods == []
    out = plan.enrich(tracks, vocabulary=TWO, raw_bpm=None, embedder=Small, threshold=0.9)
    assert out.first().moods == ["sad"] and set(out.columns) == {*tracks.columns, "genre", "sub_genres", "genres", "bpm", "moods", "mapped_mood", "confidence"}


def test_model_files(tmp_path):
    assert audio.chosen_model(str(tmp_path), "mine.pb") is None
    (tmp_path / audio.FALLBACK_MODELS[1]).write_bytes(b"x" * 20_000)
    (tmp_path / audio.FALLBACK_MODELS[0]).write_bytes(b"x" * 300)
    assert audio.chosen_model(str(tmp_path), "mine.pb").endswith(audio.FALLBACK_MODELS[1])
    mine = tmp_path / "mine.pb"
    mine.write_bytes(b"x" * 10_000)
    assert audio.chosen_model(str(tmp_path), "mine.pb") == str(mine)
    assert audio.model_description(str(mine)) == {"labels": [], "input": "serving_default_model_Placeholder", "output": "PartitionedCall:0", "two_stage": False}
    outputs = [{"name": "vectors"}, {"name": "scores", "output_purpose": "predictions"}]
    about = {"classes": ["a", "b"], "schema": {"inputs": [{"name": "in"}], "outputs": outputs}, "note": "x" * 100}
    mine.with_suffix(".json").write_text(json.dumps(about))
    assert audio.model_description(str(mine)) == {"labels": ["a", "b"], "input": "in", "output": "scores", "two_stage": False}
    mine.with_suffix(".json").write_text("{" * 200)
    assert audio.model_description(str(mine))["labels"] == []


def test_two_stages_and_tempo(spark):
    files = spark.createDataFrame([("a", b"ab"), ("b", b"")], "path string, content binary")
    model = audio.TwoStage(["x"], lambda c: [[float(b)] for b in c], lambda frames: [[f[0] / 100] for f in frames])
    assert [(r.key, r.frame, r.scores) for r in audio.infer(files, model).collect()] == [("a", 0, [0.97]), ("a", 1, [0.98])]
    got = {r.path: r.bpm for r in audio.tempo(files, [lambda c: 1 / 0, lambda c: 120.5 if c else -3.0]).collect()}
    assert got == {"a": 120, "b": None}


def test_pushed_edits(spark):
    edits = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key int, mood string")

    def call(row):
        if row["mood"] == "b":
            raise ValueError
        return row["mood"] != "c"

    assert {r.key: r.done for r in sinks.push(edits, "key", call).collect()} == {1: True, 2: False, 3: False}
    assert {r.done for r in sinks.push(edits, "key", call, dry_run=True).collect()} == {True}


def test_exports():
    assert all(callable(getattr(cantera, name)) for name in cantera.__all__)
