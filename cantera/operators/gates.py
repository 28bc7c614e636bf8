"""Filters over tags, tracks and artists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.functions.text import bound, contains_any, normalised, one_of, or_empty, tokens
from cantera.plans import vocab as V


def with_fallback(kept: Column, every: Column) -> Column:
    return bound(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(every))


def genre_tags(tags: Column) -> Column:
    """Tags with a genre keyword in them; all tags if there are none."""
    return bound(
        or_empty(F.array_compact(tags)),
        lambda t: with_fallback(F.filter(t, lambda x: contains_any(F.lower(x), V.GENRE_KEYWORDS)), t),
    )


def style_tags(tags: Column) -> Column:
    """Tags that are not just a general genre; all tags if there are none. Repeats stay."""
    return bound(
        or_empty(F.array_compact(tags)),
        lambda t: with_fallback(F.filter(t, lambda x: ~one_of(normalised(x), V.GENERIC_PRIMARY)), t),
    )


def _names_it(tag: Column, name: Column) -> Column:
    """Whether a tag tells of the name: one inside the other, or a longer word of it."""
    return bound(
        normalised(name),
        lambda n: F.contains(tag, n)
        | F.contains(n, tag)
        | F.exists(tokens(n), lambda w: (F.length(w) > 3) & F.contains(tag, w)),
    )


def mood_tag_reason(tag: Column, artist: Column, album: Column) -> Column:
    """Why a tag is no mood tag: genre, artist, album, digit, unknown or boilerplate; null if it is one.

    A missing artist counts as empty and an empty artist rejects every tag; a missing
    or empty album rejects none.
    """
    return bound(
        normalised(tag),
        lambda t: F.when(contains_any(t, V.GENRE_KEYWORDS), "genre")
        .when(_names_it(t, F.coalesce(artist, F.lit(""))), "artist")
        .when((F.coalesce(album, F.lit("")) != "") & _names_it(t, F.coalesce(album, F.lit(""))), "album")
        .when(t.rlike(r"\p{N}"), "digit")
        .when(~contains_any(t, V.MOOD_KEYWORDS), "unknown")
        .when(contains_any(t, V.BOILERPLATE), "boilerplate"),
    )


def mood_tags(tags: Column, artist: Column, album: Column) -> Column:
    return F.filter(or_empty(F.array_compact(tags)), lambda t: mood_tag_reason(t, artist, album).isNull())


def same_artist(expected: Column, candidate: Column) -> Column:
    """Whether a candidate is the artist looked for, perhaps with a guest. Not symmetric:
    the guest may stand on the candidate only. An empty or missing side always fits."""
    e, c = normalised(F.coalesce(expected, F.lit(""))), normalised(F.coalesce(candidate, F.lit("")))
    guest = F.lit(False)
    for separator in V.ARTIST_SEPARATORS:
        guest = guest | F.startswith(c, F.concat(e, F.lit(separator)))
    return (e == "") | (c == "") | (e == c) | (e == F.concat(F.lit("the "), c)) | (c == F.concat(F.lit("the "), e)) | guest


def by_artist(tracks: DataFrame, needle: str | None, column: str = "artist") -> DataFrame:
    """Tracks whose artist contains the needle, ignoring case; without one, all."""
    return tracks.where(F.contains(F.lower(column), F.lit(needle.lower()))) if needle else tracks


def remapped(path: Column, source: str, target: str) -> Column:
    """The path with its leading ``source`` replaced, if both are given and it starts with it."""
    if not source or not target:
        return path
    return F.when(
        F.startswith(path, F.lit(source)), F.concat(F.lit(target), F.substring(path, len(source) + 1, 1 << 30))
    ).otherwise(path)


def present(tracks: DataFrame, files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(tracks whose file is listed, the others); a null or empty path is never listed."""
    listed = files.select(F.col(path).alias("_file")).where("_file <> ''").distinct()
    keyed = tracks.withColumn("_key", F.col(path))
    here = keyed.join(listed, keyed["_key"] == listed["_file"], "left_semi").drop("_key")
    gone = keyed.join(listed, keyed["_key"] == listed["_file"], "left_anti").drop("_key")
    return here, gone


def unprocessed(tracks: DataFrame, state: DataFrame, overwrite: bool = False, key: str = "rating_key") -> DataFrame:
    """Tracks not in the state; with ``overwrite`` all of them and the state is not read."""
    return tracks if overwrite else tracks.join(state.select(key).distinct(), key, "left_anti")


def chosen(tracks: DataFrame, limit: int | None = None, seed: int | None = None, key: str = "rating_key") -> DataFrame:
    """The first ``limit`` tracks by key, or in a random order fixed by the seed."""
    if seed is not None:
        tracks = tracks.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key)
    elif limit is not None:
        tracks = tracks.orderBy(key)
    return tracks if limit is None else tracks.limit(limit)
