"""Genre, styles and moods named by tags, worked out for many rows in one Arrow pass.

The rules are those of ``gates``, ``matcher`` and ``genre``; what depends on a tag alone (its
keywords, what it hits in a vocabulary) is worked out once for each distinct tag of a worker,
what depends on the row is put together from that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cantera.operators.matcher import PRIMARY, SUB, TOP_TAGS, Vocabulary, lookup
from cantera.plans import vocab as V

NAMES = T.ArrayType(T.StringType())
REMEMBERED = 1 << 17


@lru_cache(REMEMBERED)
def _plain(text: str) -> str:
    return text.strip().lower()


@lru_cache(REMEMBERED)
def _of_genre(tag: str) -> bool:
    low = tag.lower()
    return any(k in low for k in V.GENRE_KEYWORDS)


@lru_cache(REMEMBERED)
def _of_style(tag: str) -> bool:
    return _plain(tag) not in V.GENERIC_PRIMARY


@lru_cache(REMEMBERED)
def _of_mood(tag: str) -> bool:
    """Whether a tag may name a mood, as far as the tag alone tells."""
    t = _plain(tag)
    return (
        not any(k in t for k in V.GENRE_KEYWORDS)
        and not any(c.isnumeric() for c in t)
        and any(k in t for k in V.MOOD_KEYWORDS)
        and not any(k in t for k in V.BOILERPLATE)
    )


@lru_cache(REMEMBERED)
def _long_words(name: str) -> tuple[str, ...]:
    return tuple(w for w in name.split() if len(w) > 3)


def _names_it(tag: str, name: str) -> bool:
    return name in tag or tag in name or any(w in tag for w in _long_words(name))


def mood_gate(tags: list[str], artist: str | None, album: str | None) -> list[str]:
    kept = [t for t in tags if _of_mood(t)]
    if not kept:
        return kept
    who, what = _plain(artist or ""), _plain(album) if album else None
    return [t for t in kept if not _names_it(_plain(t), who) and (what is None or not _names_it(_plain(t), what))]


@cache
def _core(tag: str) -> bool:
    return any(k in tag for k in V.CORE_KEYWORDS)


def _vote(found: list[tuple[str, str, float]], tags: list[str]) -> str | None:
    """The target of the heaviest match; of equal weights the better match."""
    best, kept = 0, None
    for target, raw, _ in found:
        tag = _plain(raw)
        early = next((i for i, t in enumerate(tags) if _plain(t) == tag), len(tags)) < 3
        weight = (3 if _core(tag) else 1) + (5 if early else 0)
        if weight > best:
            best, kept = weight, target
    return kept


def united(lists: tuple[list[str], ...]) -> list[str]:
    first: dict[str, str] = {}
    for tags in lists:
        for t in tags:
            first.setdefault(t.lower(), t)
    return list(first.values())


def genre_of(every: list[str]) -> str | None:
    tags = [t for t in every if _of_genre(t)] or every
    return _vote(lookup(PRIMARY).match(tags[:TOP_TAGS], 3), tags)


def styles_of(specific: list[str], every: list[str]) -> list[str]:
    if not every:
        return []
    for tags in (specific, every) if specific else (every,):
        found = lookup(SUB).match(([t for t in tags if _of_style(t)] or tags)[:TOP_TAGS], 3)
        if found:
            return [target for target, *_ in found]
    return []


def moods_of(specific: list[str], artist: str | None, album: str | None, vocabulary: Vocabulary) -> list[str]:
    tags = mood_gate(specific, artist, album)
    return [target for target, *_ in lookup(vocabulary).match(tags[:TOP_TAGS], 3)] if tags else []


def _rows(lists: pa.Array) -> Iterator[list[str]]:
    """Each row's values without nulls; a null list has none."""
    flat = pc.list_flatten(lists)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    here = flat.is_valid().to_numpy(zero_copy_only=False)
    ends = np.searchsorted(row[here], np.arange(len(lists) + 1)).tolist()
    values = flat.drop_null().to_pylist()
    return (values[a:b] for a, b in zip(ends, ends[1:]))


def with_text(
    df: DataFrame,
    specific: str | None = None,
    every: str | tuple[str, ...] | None = None,
    genre: str | None = None,
    styles: str | None = None,
    moods: str | None = None,
    gate: str | None = None,
    vocabulary: Vocabulary | None = None,
) -> DataFrame:
    """``df`` with those of the columns ``genre`` (from ``every``), ``styles`` (from
    ``specific``, else ``every``), ``moods`` and ``gate``, the tags that may name moods
    (both from ``specific``, ``artist`` and ``album``), that are named.

    Null tags are dropped before places are counted; a null list is an empty one. Where
    ``every`` names several columns, their tags are united in this order, the first of each
    ignoring case.
    """
    schema, columns = T.StructType(list(df.schema.fields)), df.columns
    wanted = [(name, kind) for name, kind in ((genre, T.StringType()), (styles, NAMES), (moods, NAMES), (gate, NAMES)) if name]
    for name, kind in wanted:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(columns)}
            own = list(_rows(at[specific])) if specific else None
            if isinstance(every, tuple):
                wide = [united(lists) for lists in zip(*(_rows(at[c]) for c in every))]
            else:
                wide = list(_rows(at[every])) if every else None
            out = list(batch.columns)
            if genre:
                out.append(pa.array([genre_of(t) for t in wide], pa.string()))
            if styles:
                out.append(pa.array([styles_of(a, b) for a, b in zip(own, wide)], pa.list_(pa.string())))
            if moods or gate:
                who, what = at["artist"].to_pylist(), at["album"].to_pylist()
            if moods:
                out.append(pa.array([moods_of(t, a, b, vocabulary) for t, a, b in zip(own, who, what)], pa.list_(pa.string())))
            if gate:
                out.append(pa.array([mood_gate(t, a, b) for t, a, b in zip(own, who, what)], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(out, names=[*columns, *(n for n, _ in wanted)])

    return df.mapInArrow(run, schema)
