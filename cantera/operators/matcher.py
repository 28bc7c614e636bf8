"""Ordered tags against a taxonomy: lexical rules, rank decay, optional vectors.

A row's tags are matched on its own array, with the vocabulary as a constant: no row
is exploded and nothing is shuffled, whatever the number of rows. Only the first five
tags can match by their letters.

There are two ways with one result. ``match_tags`` is an expression; it takes vectors
and works inside other expressions, but tries every target on every tag in
interpreted lambdas, about a millisecond a row for 82 targets. ``match_lists`` is an
Arrow pass over a table: it works out a distinct tag once for each worker and then
only puts together what a row's tags hit, some ten microseconds a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantera.functions.text import bound, constant, contains_any, normalised, one_of, or_empty, strings, words_of
from cantera.plans import vocab as V

TOP_TAGS = 5
CONSENSUS_TAGS = 3
MATCHES = "array<struct<target:string,raw:string,score:double>>"


@dataclass(frozen=True)
class Vocabulary:
    """Targets in their order of preference. ``vectors``: whether a target without a
    lexical hit may be reached by similarity; ``consensus``: whether matches are kept
    to those from the first three tags where there are any."""

    targets: tuple[str, ...]
    vectors: bool = True
    consensus: bool = False

    @property
    def exclusive(self) -> tuple[tuple[str, str], ...]:
        return tuple(p for p in V.EXCLUSIVE_STYLES if p[0] in self.targets and p[1] in self.targets)


PRIMARY = Vocabulary(V.PRIMARY_GENRES, vectors=False)
SUB = Vocabulary(V.SUB_GENRES, vectors=False, consensus=True)
MOODS = Vocabulary(V.CONFIGURED_MOODS)
MOOD_TAGS = Vocabulary(V.MOOD_TAGS)


def target_rows(targets: tuple[str, ...]) -> list[dict]:
    """What matching needs to know of each target."""
    rows = []
    for order, target in enumerate(targets):
        clean = target.lower().strip()
        words = sorted(set(clean.replace("-", " ").split()))
        rows.append(
            {
                "ord": order,
                "target": target,
                "clean": clean,
                "spaced": clean.replace("-", " "),
                "words": words,
                "compound": len(words) > 1,
                "stems": [*V.PRIMARY_STEMS.get(target, ()), *V.SUB_STEMS.get(target, ())],
                "is_rock": target == "Rock",
                "is_americana": target == "Americana",
                "indie": target in V.INDIE_CONTEXT,
                "by_vector": clean not in V.NEEDS_KEYWORD,
            }
        )
    return rows


TARGET = (
    "array<struct<ord:int,target:string,clean:string,spaced:string,words:array<string>,compound:boolean,"
    "stems:array<string>,is_rock:boolean,is_americana:boolean,indie:boolean,by_vector:boolean>>"
)


def _constant(targets: tuple[str, ...]) -> Column:
    return constant(target_rows(targets), TARGET)


def _prepared(tags: Column) -> Column:
    """The first tags with what the rules look at."""

    def one(raw: Column, rank: Column) -> Column:
        return bound(
            normalised(raw),
            lambda clean: bound(
                words_of(clean),
                lambda words: F.struct(
                    raw.alias("raw"),
                    rank.cast("int").alias("rank"),
                    F.greatest(F.lit(0.50), F.lit(1.0) - rank * F.lit(0.04)).alias("factor"),
                    clean.alias("clean"),
                    words.alias("words"),
                    one_of(clean, V.MODIFIERS).alias("modifier"),
                    one_of(clean, V.NATIONALITIES).alias("nationality"),
                    contains_any(clean, ("punk", "metal")).alias("heavier"),
                    F.array_contains(words, "indie").alias("indie"),
                ),
            ),
        )

    return F.transform(F.slice(tags, 1, TOP_TAGS), one)


def _indie_styles(tags: Column) -> Column:
    """The indie styles that the first three tags speak for."""
    first = F.transform(F.slice(tags, 1, CONSENSUS_TAGS), F.lower)
    found = [
        F.when(_any_tag(first, words), F.lit(style)) for style, words in V.INDIE_CONTEXT.items()
    ]
    return F.array_compact(F.array(*found))


def _any_tag(tags: Column, words) -> Column:
    return F.exists(tags, lambda t: contains_any(t, words))


def _score(v: Column, p: Column, styles: Column) -> Column:
    """Score of one tag for one target, null if it does not match."""
    exact = (p["clean"] == v["clean"]) | ((F.length(p["clean"]) > 3) & (p["clean"] == v["spaced"]))
    within = F.contains(v["clean"], p["clean"]) | (
        (F.size(p["words"]) > 0) & (F.size(F.array_except(p["words"], v["words"])) == 0)
    )
    included = ~(v["compound"] & p["modifier"]) & (F.length(p["clean"]) >= 3) & within
    indie = v["indie"] & p["indie"] & F.array_contains(styles, v["target"])
    stem = ~(v["is_rock"] & p["heavier"]) & F.exists(v["stems"], lambda s: F.contains(p["clean"], s))
    loose = (included | indie | stem) & ~(v["is_americana"] & p["nationality"])
    return F.when(exact, F.lit(1.0) * p["factor"]).when(loose, F.lit(0.95) * p["factor"])


def lexical_hits(tags: Column, vocabulary: Vocabulary) -> Column:
    """The best tag for every target that has one: array of (ord, target, raw, rank, score)
    in vocabulary order. Of equal scores the tag ranked higher wins."""

    def best(v: Column, prepared: Column, styles: Column) -> Column:
        scored = F.transform(
            prepared,
            lambda p: bound(
                _score(v, p, styles),
                lambda s: F.when(
                    s.isNotNull(), F.struct(s.alias("score"), (-p["rank"]).alias("order"), p["raw"].alias("raw"))
                ),
            ),
        )
        return F.array_max(scored)

    def all_targets(prepared: Column, styles: Column) -> Column:
        hits = F.transform(
            _constant(vocabulary.targets),
            lambda v: bound(
                best(v, prepared, styles),
                lambda b: F.when(
                    b.isNotNull(),
                    F.struct(
                        v["ord"].alias("ord"), v["target"].alias("target"), b["raw"].alias("raw"),
                        (-b["order"]).alias("rank"), b["score"].alias("score"),
                    ),
                ),
            ),
        )
        return F.array_compact(hits)

    return bound(_prepared(tags), lambda prepared: bound(_indie_styles(tags), lambda styles: all_targets(prepared, styles)))


def vector_hits(tags: Column, vocabulary: Vocabulary, hits: Column, similarity: Column, threshold: float) -> Column:
    """Targets without a lexical hit that come near enough by similarity.

    ``similarity`` holds for each target, in vocabulary order, the cosine to each tag.
    The nearest tag is chosen before the decay by rank; if it is too general the
    target is given up.
    """

    def one(v: Column) -> Column:
        sims = F.get(similarity, v["ord"])
        return bound(
            F.array_position(sims, F.array_max(sims)).cast("int") - 1,
            lambda r: bound(
                F.get(sims, r) * F.greatest(F.lit(0.40), F.lit(1.0) - r * F.lit(0.05)),
                lambda score: F.when(
                    v["by_vector"]
                    & (score >= F.lit(threshold * 0.80))
                    & ~one_of(normalised(F.get(tags, r)), V.GENERIC_FOR_VECTORS)
                    & ~F.exists(hits, lambda h: h["ord"] == v["ord"]),
                    F.struct(
                        v["ord"].alias("ord"), v["target"].alias("target"), F.get(tags, r).alias("raw"),
                        r.alias("rank"), score.alias("score"),
                    ),
                ),
            ),
        )

    return F.array_compact(F.transform(_constant(vocabulary.targets), one))


def _without_conflicts(ranked: Column, pairs) -> Column:
    """Walks down the ranking and leaves out what excludes something kept."""
    if not pairs:
        return ranked

    def clash(x: Column, y: Column) -> Column:
        tests = [(x == a) & (y == b) | (x == b) & (y == a) for a, b in pairs]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    start = F.slice(ranked, 1, 0)
    return F.aggregate(
        ranked,
        start,
        lambda kept, x: F.when(F.exists(kept, lambda y: clash(x["target"], y["target"])), kept).otherwise(
            F.array_append(kept, x)
        ),
    )


def match_tags(
    tags: Column,
    vocabulary: Vocabulary,
    k: int = 3,
    similarity: Column | None = None,
    threshold: float = 0.45,
) -> Column:
    """Up to k matches (target, raw, score), best first, ties in vocabulary order.

    Null and empty lists have no matches; null tags are dropped before ranks are counted.
    """
    clean = or_empty(F.array_compact(tags))

    def ranked(found: Column) -> Column:
        order = F.transform(
            found,
            lambda h: F.struct((-h["score"]).alias("a"), h["ord"].alias("b"), h["target"].alias("target"),
                               h["raw"].alias("raw"), h["rank"].alias("rank"), h["score"].alias("score")),
        )
        return F.array_sort(order)

    def finish(hits: Column, t: Column) -> Column:
        found = hits
        if similarity is not None and vocabulary.vectors:
            found = F.concat(hits, vector_hits(t, vocabulary, hits, similarity, threshold))
        kept = _without_conflicts(ranked(found), vocabulary.exclusive)
        if vocabulary.consensus:
            kept = F.when(
                F.exists(hits, lambda h: h["rank"] < CONSENSUS_TAGS), F.filter(kept, lambda h: h["rank"] < CONSENSUS_TAGS)
            ).otherwise(kept)
        return F.transform(
            F.slice(kept, 1, k),
            lambda h: F.struct(h["target"].alias("target"), h["raw"].alias("raw"), h["score"].alias("score")),
        )

    return bound(clean, lambda t: bound(lexical_hits(t, vocabulary), lambda hits: finish(hits, t)))


def targets_of(matches: Column) -> Column:
    return F.transform(matches, lambda m: m["target"])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, accumulated in double; a vector's length counts as 1e-9 at least."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z
        )

    def norm(x: Column) -> Column:
        return F.greatest(F.sqrt(dot(x, x)), F.lit(1e-9))

    return dot(a, b) / (norm(a) * norm(b))


def similarities(tag_vectors: Column, target_vectors: Column) -> Column:
    """For each target vector the cosines to all tag vectors."""
    return F.transform(target_vectors, lambda t: F.transform(tag_vectors, lambda v: cosine(v, t)))


def best_pair(tags: Column, vocabulary: Vocabulary, similarity: Column, threshold: float = 0.45) -> Column:
    """STRUCT<accepted, best, raw, score>: the nearest pair of any tag and any target.

    ``accepted`` is null below the threshold while the pair is still told. Equal
    scores go to the tag ranked higher, then to the earlier target. Without tags or
    vectors everything is null and the score 0.
    """
    names = strings(vocabulary.targets)
    flat = F.flatten(
        F.transform(
            similarity,
            lambda sims, c: F.transform(
                sims, lambda s, r: F.struct(s.alias("score"), (-r).alias("rank"), (-c).alias("ord"))
            ),
        )
    )

    def told(b: Column) -> Column:
        target = F.get(names, -b["ord"])
        return F.struct(
            F.when(b["score"] >= threshold, target).alias("accepted"),
            target.alias("best"),
            F.get(tags, -b["rank"]).alias("raw"),
            F.coalesce(b["score"], F.lit(0.0)).alias("score"),
        )

    return bound(F.array_max(flat), told)


#: The same under its other name.
map_tags = best_pair


class _Lookup:
    """What each distinct tag hits in a vocabulary, kept between batches of a worker."""

    MOST = 200_000  # distinct tags remembered

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.rows = vocabulary, target_rows(vocabulary.targets)
        self.clash = {}
        for a, b in vocabulary.exclusive:
            self.clash.setdefault(a, set()).add(b)
            self.clash.setdefault(b, set()).add(a)
        self.known: dict[str, tuple[tuple[int, float], ...]] = {}

    def hits(self, raw: str) -> tuple[tuple[int, float], ...]:
        """(target's place, share of the rank factor); 0 for what needs an indie context."""
        found = self.known.get(raw)
        if found is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            tag = raw.lower().strip()
            words = set(tag.replace("-", " ").split())
            found = self.known[raw] = tuple(
                (v["ord"], share) for v in self.rows if (share := self._share(v, tag, words)) is not None
            )
        return found

    @staticmethod
    def _share(v: dict, tag: str, words: set[str]) -> float | None:
        if tag == v["clean"] or len(tag) > 3 and tag == v["spaced"]:
            return 1.0
        if v["is_americana"] and tag in V.NATIONALITIES:
            return None
        general = v["compound"] and tag in V.MODIFIERS
        if len(tag) >= 3 and not general and (tag in v["clean"] or words and words.issubset(v["words"])):
            return 0.95
        if not (v["is_rock"] and ("punk" in tag or "metal" in tag)) and any(s in tag for s in v["stems"]):
            return 0.95
        return 0.0 if v["indie"] and "indie" in words else None

    def styles(self, tags: list[str]) -> set[str]:
        first = [t.lower() for t in tags[:CONSENSUS_TAGS]]
        return {s for s, words in V.INDIE_CONTEXT.items() if any(w in t for t in first for w in words)}

    def match(self, tags: list[str], k: int) -> list[tuple[str, str, float]]:
        best: dict[int, tuple[float, int]] = {}
        styles = None
        for rank, raw in enumerate(tags[:TOP_TAGS]):
            factor = max(0.50, 1.0 - rank * 0.04)
            for order, share in self.hits(raw):
                if share == 0.0:
                    styles = self.styles(tags) if styles is None else styles
                    if self.vocabulary.targets[order] not in styles:
                        continue
                    share = 0.95
                score = share * factor
                if order not in best or score > best[order][0]:
                    best[order] = score, rank
        kept: list[tuple[str, int, float]] = []
        for order, (score, rank) in sorted(best.items(), key=lambda x: (-x[1][0], x[0])):
            target = self.vocabulary.targets[order]
            excluded = self.clash.get(target)
            if not excluded or not any(other in excluded for other, *_ in kept):
                kept.append((target, rank, score))
        if self.vocabulary.consensus and any(rank < CONSENSUS_TAGS for _, rank in best.values()):
            kept = [x for x in kept if x[1] < CONSENSUS_TAGS]
        return [(target, tags[rank], score) for target, rank, score in kept[:k]]


@cache
def lookup(vocabulary: Vocabulary) -> _Lookup:
    return _Lookup(vocabulary)


def _matched(alternatives: list[pa.Array], known: _Lookup, k: int) -> pa.Array:
    """Matches of each row's first list that has any."""
    rows = []
    for lists in alternatives:
        flat = pc.list_flatten(lists)
        row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        here = flat.is_valid().to_numpy(zero_copy_only=False)
        ends = np.searchsorted(row[here], np.arange(len(lists) + 1)).tolist()
        rows.append((flat.drop_null().to_pylist(), ends))
    out, sizes = [], [0]
    for i in range(len(alternatives[0])):
        for values, ends in rows:
            a, b = ends[i], ends[i + 1]
            if a < b and (found := known.match(values[a : min(b, a + TOP_TAGS)], k)):
                out += found
                break
        sizes.append(len(out))
    targets, raws, scores = zip(*out) if out else ((), (), ())
    parts = pa.StructArray.from_arrays(
        [pa.array(targets, pa.string()), pa.array(raws, pa.string()), pa.array(scores, pa.float64())], ["target", "raw", "score"]
    )
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), parts)


def match_lists(df: DataFrame, wanted: dict[str, tuple[tuple[str, ...], Vocabulary]], k: int = 3) -> DataFrame:
    """``df`` with new columns of matches: ``match_tags`` without vectors, in one Arrow pass.

    ``wanted`` names for each new column the columns of tags and the vocabulary; of
    several columns the first that gives a row any match counts.
    """
    schema = T.StructType(list(df.schema.fields))
    for name in wanted:
        schema = schema.add(name, T._parse_datatype_string(MATCHES))
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                _matched([batch.column(columns.index(t)) for t in tags], lookup(vocabulary), k)
                for tags, vocabulary in wanted.values()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*columns, *wanted])

    return df.mapInArrow(run, schema)
