"""The enrichment plan: from tagged tracks to genre, styles, tempo and moods.

One chain of projections over the rows of the catalogue: after the tag sources are
joined, nothing is shuffled any more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.functions.text import or_empty
from cantera.operators import audio, genre, moods
from cantera.operators.embedding import Embedder, with_similarity
from cantera.operators.matcher import MOODS, Vocabulary, match_tags, targets_of
from cantera.operators.text_pass import with_text

NONE = "array<string>"


@dataclass(frozen=True)
class Features:
    """What to work out; none chosen means everything."""

    genre: bool = True
    subgenre: bool = True
    mood: bool = True
    bpm: bool = True

    @staticmethod
    def chosen(genre: bool = False, subgenre: bool = False, mood: bool = False, bpm: bool = False) -> Features:
        return Features(genre, subgenre, mood, bpm) if genre or subgenre or mood or bpm else Features()


def enrich(
    tracks: DataFrame,
    features: Features = Features(),
    vocabulary: Vocabulary = MOODS,
    specific: str = "specific_tags",
    every: str | tuple[str, ...] = "all_tags",
    raw_bpm: str | None = "raw_bpm",
    mood_top: str | None = None,
    genre_top: str | None = None,
    similarity: str | None = None,
    embedder: Callable[[], Embedder] | None = None,
    threshold: float = 0.45,
    audio_threshold: float = 0.1,
    audio_labels: Sequence[str] = (),
) -> DataFrame:
    """Adds genre, sub_genres, genres, bpm, moods, mapped_mood and confidence.

    ``specific`` are the tags of the track itself, ``every`` those of all sources, in one column
    or in several that are united. The
    optional columns ``mood_top`` and ``genre_top`` hold audio predictions, whose moods count
    from ``audio_threshold`` on (``audio_labels``: the labels of the mood model, if known). With an ``embedder`` moods are also reached by the
    cosines of its vectors from ``threshold`` on; the column ``similarity`` may hold the
    cosines of mood targets to the gated tags instead. Audio styles, taken
    where no genre was found, leave text styles and the elevation of Rock out.
    """
    nothing = F.array().cast(NONE)
    here = {"genre": "_text_genre"} if features.genre else {}
    here |= {"styles": "_styles"} if features.subgenre else {}
    vectors = features.mood and (similarity is not None or embedder is not None)
    here |= ({"gate": "_gated"} if vectors else {"moods": "_text"}) if features.mood else {}
    out = with_text(tracks, specific, every, vocabulary=vocabulary, **here) if here else tracks  # all matching in one pass
    if not features.genre:
        out = out.withColumn("_text_genre", F.lit(None).cast("string"))
    if genre_top and features.genre:
        out = out.withColumn("_audio", F.when(F.col("_text_genre").isNull(), audio.audio_genres(F.col(genre_top))))
        heard, heard_subs = F.col("_audio.genre"), or_empty(F.col("_audio.sub_genres"))
    else:
        heard, heard_subs = F.lit(None).cast("string"), nothing
    out = out.withColumn("_heard", heard_subs)
    text_subs = F.col("_styles") if features.subgenre else nothing
    out = out.withColumn("sub_genres", F.when(F.size("_heard") > 0, F.col("_heard")).otherwise(text_subs))
    found = F.coalesce("_text_genre", heard)
    lifted = genre.elevated(found, F.col("sub_genres")) if features.subgenre else found
    out = out.withColumn("genre", F.when(F.size("_heard") > 0, found).otherwise(lifted))
    out = out.withColumn("genres", genre.genre_list(F.col("genre"), F.col("sub_genres")))
    bpm = audio.whole_bpm(F.col(raw_bpm)) if raw_bpm and features.bpm else F.lit(None).cast("int")
    out = out.withColumn("bpm", bpm)
    if features.mood:
        top = or_empty(F.col(mood_top) if mood_top else F.lit(None).cast(audio.TOP), audio.TOP[6:-1])
        out = out.withColumn("_top", top)
        if vectors:
            if similarity is None:
                out = with_similarity(out, "_gated", vocabulary, embedder, "_cosines")
            cosines = F.col(similarity or "_cosines")
            out = out.withColumn("_text", targets_of(match_tags(F.col("_gated"), vocabulary, similarity=cosines, threshold=threshold)))
        heard_moods = audio.audio_moods(F.col("_top"), F.col("bpm"), vocabulary, audio_threshold, audio_labels)["accepted"] if mood_top else nothing
        out = out.withColumn("_heard_moods", heard_moods)
        final: Column = moods.final_moods(
            F.col("_text"), F.col("sub_genres"), F.col("_heard_moods"), F.col("bpm"), F.col("_top")
        )
    else:
        final = nothing
    out = out.withColumn("moods", final).withColumn("mapped_mood", moods.primary_mood(F.col("moods")))
    out = out.withColumn("confidence", F.when(F.col("mapped_mood").isNotNull(), 1.0).otherwise(0.0))
    return out.drop("_styles", "_gated", "_cosines", "_text_genre", "_audio", "_heard", "_top", "_text", "_heard_moods")


def is_enriched() -> Column:
    """Whether anything was found for a track."""
    return F.col("genre").isNotNull() | (F.size("sub_genres") > 0) | (F.size("moods") > 0) | F.col("bpm").isNotNull()


def results(enriched: DataFrame, at: Column) -> DataFrame:
    """Rows for the state: everything gets one, also tracks without a mood."""
    return enriched.select(
        "rating_key", "title", "artist", "mapped_mood", "confidence", F.lit("hybrid").alias("source"),
        F.date_trunc("SECOND", at).cast("timestamp_ntz").alias("processed_at"),
    )


def run_summary(enriched: DataFrame) -> DataFrame:
    """One row of counts: tracks, enriched and skipped ones, and how many got what."""

    def n(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    return enriched.agg(
        F.count(F.lit(1)).alias("n_tracks"), n(is_enriched(), "n_enriched"), n(~is_enriched(), "n_skipped"),
        n(F.col("genre").isNotNull(), "n_genre"), n(F.size("sub_genres") > 0, "n_sub_genre"),
        n(F.size("moods") > 0, "n_mood"), n(F.col("bpm").isNotNull(), "n_bpm"),
    )


def report(enriched: DataFrame, before_moods: str = "current_moods", before_genres: str | None = None) -> DataFrame:
    """Before and after of each track as text."""

    def text(values: Column) -> Column:
        joined = F.array_join(or_empty(values), ", ")
        return F.when(joined != "", joined).otherwise("(None)")

    old_genres = F.col(before_genres) if before_genres else F.lit(None).cast(NONE)
    return enriched.select(
        "rating_key", "title", "artist", text(old_genres).alias("genres_before"), text(F.col("genres")).alias("genres_after"),
        text(F.col(before_moods)).alias("moods_before"), text(F.col("moods")).alias("moods_after"),
        F.coalesce(F.col("bpm").cast("string"), F.lit("(None)")).alias("bpm_after"),
    )


