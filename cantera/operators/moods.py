"""Moods from text, styles, audio and tempo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.functions.text import any_of, bound, constant, distinct_ignoring_case, one_of, or_empty
from cantera.operators.gates import mood_tags
from cantera.operators.matcher import MOODS, Vocabulary, match_tags, targets_of
from cantera.operators.text_pass import with_text
from cantera.plans import vocab as V


def _any_in(moods: Column, values) -> Column:
    return F.exists(moods, lambda m: one_of(F.lower(m), values))


def _without(moods: Column, values) -> Column:
    return F.filter(moods, lambda m: ~one_of(F.lower(m), values))


def text_moods(
    tags: Column, artist: Column, album: Column, vocabulary: Vocabulary = MOODS, similarity: Column | None = None
) -> Column:
    """Moods named by the track's own tags that pass the gate, as one expression."""
    return targets_of(match_tags(mood_tags(tags, artist, album), vocabulary, similarity=similarity))


def with_text_moods(df: DataFrame, tags: str, into: str, vocabulary: Vocabulary = MOODS) -> DataFrame:
    """The same for a column of many rows with ``artist`` and ``album``, in the Arrow pass."""
    return with_text(df, tags, moods=into, vocabulary=vocabulary)


def seeded_moods(subs: Column) -> Column:
    """Moods that styles suggest, in the order of the styles, each once."""
    seeds = constant({k: list(v) for k, v in V.GENRE_MOOD_SEEDS.items()}, "map<string,array<string>>")
    return F.array_distinct(F.flatten(F.transform(or_empty(subs), lambda s: or_empty(F.try_element_at(seeds, s)))))


def _prediction(top: Column, label: str) -> Column:
    """The last score of a label among the predictions, 0 if it is not there."""
    found = F.filter(or_empty(top, "struct<label:string,score:double>"), lambda p: F.lower(p["label"]) == label)
    return F.coalesce(F.try_element_at(found, F.lit(-1))["score"], F.lit(0.0))


def admitted_seeds(seeds: Column, text: Column, audio: Column, subs: Column, bpm: Column, top: Column) -> Column:
    """Seeds that tempo and audio do not contradict.

    ``text`` and ``audio`` are moods found before, ``top`` the audio predictions.
    """
    heavy, aggressive = _prediction(top, "heavy") >= 0.08, _prediction(top, "aggressive") >= 0.05
    flags = F.struct(
        any_of(
            (
                _prediction(top, "energetic") >= 0.15, heavy, aggressive, _prediction(top, "dark") >= 0.10,
                _any_in(or_empty(audio), V.ROWDY_MOODS), _any_in(or_empty(subs), V.ROWDY_STYLES),
            )
        ).alias("rowdy"),
        F.coalesce(bpm >= 125, F.lit(False)).alias("fast"),
        (F.coalesce(bpm < 100, F.lit(False)) & ~(heavy | aggressive)).alias("slow"),
        (F.size(or_empty(audio)) == 0).alias("silent"),
        F.concat(or_empty(text), or_empty(audio)).alias("found"),
    )

    def keep(seed: Column, f: Column) -> Column:
        agreed = f["silent"] | F.array_contains(f["found"], seed)
        low = F.lower(seed)
        return (
            F.when(low == "chill hang", ~(f["fast"] | f["rowdy"]))
            .when(low.isin("rowdy", "aggressive", "heavy"), ~f["slow"] & agreed)
            .otherwise(agreed)
        )

    return bound(flags, lambda f: F.filter(seeds, lambda s: keep(s, f)))


def combined_moods(text: Column, seeds: Column, audio: Column) -> Column:
    """Text moods, admitted seeds, audio moods; each spelling once, in this order."""
    return F.array_distinct(F.concat(or_empty(text), or_empty(seeds), or_empty(audio)))


def tempo_checked(moods: Column, bpm: Column) -> Column:
    """From 130 no lively; from 110 energetic becomes lively; below neither."""
    renamed = F.transform(moods, lambda m: F.when(F.lower(m) == "energetic", F.lit("Lively")).otherwise(m))
    return (
        F.when(bpm.isNull(), moods)
        .when(bpm >= 130, _without(moods, ("lively",)))
        .when(bpm >= 110, distinct_ignoring_case(renamed))
        .otherwise(_without(moods, ("energetic", "lively")))
    )


def without_conflicts(moods: Column) -> Column:
    """Six passes, each over what the one before it left."""

    def passes(m: Column, rules) -> Column:
        if not rules:
            both = _any_in(m, ("energetic",)) & _any_in(m, ("lively",))
            return F.when(both, _without(m, ("lively",))).otherwise(m)
        (present, dropped), *rest = rules
        return bound(F.when(_any_in(m, present), _without(m, dropped)).otherwise(m), lambda x: passes(x, rest))

    return bound(moods, lambda m: passes(m, list(V.MOOD_CONFLICTS)))


def specific_first(moods: Column) -> Column:
    general = ("energetic", "lively")
    return F.concat(_without(moods, general), F.filter(moods, lambda m: one_of(F.lower(m), general)))


def final_moods(text: Column, subs: Column, audio: Column, bpm: Column, top: Column) -> Column:
    """All mood rules in their order."""
    seeds = bound(seeded_moods(subs), lambda s: admitted_seeds(s, text, audio, subs, bpm, top))
    combined = bound(combined_moods(text, seeds, audio), lambda m: tempo_checked(m, bpm))
    return bound(combined, lambda m: bound(without_conflicts(m), specific_first))


def primary_mood(moods: Column) -> Column:
    return F.try_element_at(moods, F.lit(1))
