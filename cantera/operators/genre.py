"""Primary genre, sub-genres and the genre list of a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.functions.text import bound, contains_any, distinct_ignoring_case, normalised, one_of, or_empty
from cantera.operators.gates import genre_tags, style_tags
from cantera.operators.matcher import PRIMARY, SUB, match_tags, targets_of
from cantera.operators.text_pass import with_text
from cantera.plans import vocab as V


def tag_union(*sources: Column) -> Column:
    """Tags of all sources in their order, the first of each ignoring case."""
    return distinct_ignoring_case(F.concat(*[or_empty(s) for s in sources]))


def vote(matches: Column, tags: Column) -> Column:
    """The genre of the heaviest match: 3 for a core keyword in its tag, else 1, and 5 more
    if the tag first stands among the first three; the better match wins a tie."""

    def weighed(lowered: Column) -> Column:
        def weight(m: Column, i: Column) -> Column:
            raw = normalised(m["raw"])
            core = F.when(contains_any(raw, V.CORE_KEYWORDS), 3).otherwise(1)
            early = F.when(F.array_position(lowered, raw).between(1, 3), 5).otherwise(0)
            return F.struct((core + early).alias("weight"), (-i).alias("order"), m["target"].alias("target"))

        return F.array_max(F.transform(matches, weight))["target"]

    return bound(F.transform(tags, normalised), weighed)


def primary_genre(tags: Column) -> Column:
    """The genre of a list of tags as one expression; null without tags or matches."""
    return bound(genre_tags(tags), lambda t: vote(match_tags(t, PRIMARY), t))


def with_primary_genre(df: DataFrame, tags: str, into: str = "genre") -> DataFrame:
    """The same for a column of many rows, in the Arrow pass."""
    return with_text(df, every=tags, genre=into)


def sub_genres(specific: Column, every: Column) -> Column:
    """Up to three styles from the track's own tags, else from all tags; none without any tags."""
    own, wide = or_empty(F.array_compact(specific)), or_empty(F.array_compact(every))

    def styles(tags: Column) -> Column:
        return targets_of(match_tags(style_tags(tags), SUB))

    first = bound(F.when(F.size(own) > 0, own).otherwise(wide), styles)
    return bound(
        first,
        lambda found: F.when(F.size(wide) == 0, F.slice(found, 1, 0))
        .when((F.size(found) == 0) & (F.size(own) > 0), styles(wide))
        .otherwise(found),
    )


def with_sub_genres(df: DataFrame, specific: str, every: str, into: str = "sub_genres") -> DataFrame:
    """The same for columns of many rows, in the Arrow pass."""
    return with_text(df, specific, every, styles=into)


def elevated(genre: Column, subs: Column) -> Column:
    """Rock becomes Punk or else Metal if a style says so."""

    def has(styles) -> Column:
        return F.exists(or_empty(subs), lambda s: one_of(F.lower(s), styles))

    return F.when((genre == "Rock") & has(V.PUNK_STYLES), "Punk").when((genre == "Rock") & has(V.METAL_STYLES), "Metal").otherwise(genre)


def genre_list(genre: Column, subs: Column) -> Column:
    """The genre, if any, and the styles."""
    return F.concat(F.array_compact(F.array(genre)), or_empty(subs))
