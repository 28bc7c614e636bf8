"""The driver's tables as a music library: the views that the queries run on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.functions.text import normalised, or_empty, strings
from cantera.operators import audio, genre
from cantera.operators.state import last_by_key
from cantera.plans import vocab as V
from cantera.session import table
from cantera.sources.payloads import most_used_tags

#: Tags of the taxonomy and around it, for queries that need more of it than the tables hold.
DRAWN = (*V.SUB_GENRES, *V.CONFIGURED_MOODS, *V.MODIFIERS, "american", "90s metal", "seen live", "  Hip Hop ", "dark wave")
#: Labels of the 64 classes that the embeddings stand in for.
LABELS = (*V.AUDIO_LABEL_MOODS, *V.AUDIO_GENERIC_LABELS, "melodic", "calm guitar", "deep", "cool", *(f"class {i}" for i in range(25)))
GENRE_LABELS = tuple(
    f"{g}---{s}" for g, s in zip(("Rock", "Folk, World", "Hip Hop", "Electronic", "Jazz", "Pop", "Metal", "Blues"), V.SUB_GENRES[::10])
)


#: The tags of a track, its album and its artist, in the order they are united in.
SOURCES = ("specific_tags", "album_tags", "artist_tags")


def drawn_tag(tag: Column, place: Column, row_id: Column) -> Column:
    """A tag of ``DRAWN`` that depends on the tag's length, its place and the row."""
    at = (F.length(tag) * 31 + place * 17 + row_id * 7) % len(DRAWN)
    return F.get(strings(DRAWN), at.cast("int"))


def latest_tempo(spark: SparkSession, d: str) -> DataFrame:
    readings = table(spark, d, "tempo_readings").select("rating_key", "read_at", "reading_id", "raw_bpm")
    return last_by_key(readings, "rating_key", ["read_at", "reading_id"]).select("rating_key", "raw_bpm")


def library(spark: SparkSession, d: str) -> DataFrame:
    """Every catalogue row with its own tags, the tags of all sources and its last tempo."""
    tracks = table(spark, d, "track_items").select(
        "row_id", "rating_key", "title", "artist", "album", "file_path", "current_moods",
        F.array_compact(or_empty(F.col("raw_tags"))).alias("specific_tags"),
        normalised(F.col("artist")).alias("_artist"), normalised(F.col("album")).alias("_album"),
    )
    albums = most_used_tags(tracks.where("_album <> ''"), ["_artist", "_album"], "specific_tags").withColumnRenamed("tags", "album_tags")
    artists = most_used_tags(tracks, ["_artist"], "specific_tags").withColumnRenamed("tags", "artist_tags")
    joined = tracks.join(albums, ["_artist", "_album"], "left").join(artists, "_artist", "left")
    every = genre.tag_union(F.col("specific_tags"), F.col("album_tags"), F.col("artist_tags"))
    return joined.withColumn("all_tags", every).drop("_artist", "_album").join(latest_tempo(spark, d), "rating_key", "left")


def drawn_library(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue rows whose tags are drawn from the taxonomy: all of them and, as the
    track's own, those at even places. Beside the queries on the stored tags, for
    the rules that these never meet."""
    tags = F.array_compact(or_empty(F.col("raw_tags")))
    drawn = F.transform(tags, lambda t, i: drawn_tag(t, i, F.col("row_id")))
    rows = table(spark, d, "track_items").select("row_id", "rating_key", "artist", "album", drawn.alias("all_tags"))
    rows = rows.withColumn("specific_tags", F.filter("all_tags", lambda t, i: i % 2 == 0))
    return rows.join(latest_tempo(spark, d), "rating_key", "left")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(key, class, score): embeddings as frames of recordings of eight frames, in exact arithmetic."""
    scores = F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")) * 1e6).cast("bigint"))
    frames = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("int").alias("key"), scores.alias("scores"))
    means = audio.pooled(frames, "key", "scores")
    spread = (F.col("class") % 10 + 1) / F.lit(10.0)
    return means.select("key", "class", F.round(F.col("score") / 1e6 * spread, 10).alias("score"))


def recordings(spark: SparkSession, d: str) -> DataFrame:
    """(key, top): the ten best labelled predictions of each recording."""
    return audio.top_labels(audio.top_classes(predictions(spark, d), "key"), "key", list(LABELS))


def genre_recordings(spark: SparkSession, d: str) -> DataFrame:
    """(key, genre_top): the same predictions under labels of genres and styles."""
    labels = [GENRE_LABELS[i % len(GENRE_LABELS)] for i in range(len(LABELS))]
    return audio.top_labels(audio.top_classes(predictions(spark, d), "key"), "key", labels).withColumnRenamed("top", "genre_top")


class LetterCounts:
    """A small embedder without a model: how often each letter occurs."""

    letters = "abcdefghijklmnopqrstuvwxyz"

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(c) for c in self.letters] for t in texts], float)
