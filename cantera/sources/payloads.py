"""Tags out of stored answers of remote services: HTML pages and JSON documents.

Look-ups are made once for each distinct key, not for each track: a source is a
table keyed by normalised names that tracks are joined to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantera.functions.text import bound, distinct_ignoring_case, normalised, or_empty, url_decoded
from cantera.operators.gates import same_artist

#: Fixed value: how a page links to a tag.
TAG_LINK = r"/tag/([^\"/?#]+)"

_NAMED = "ARRAY<STRUCT<name: STRING>>"
RECORDINGS = f"""STRUCT<recordings: ARRAY<STRUCT<
    tags: {_NAMED}, genres: {_NAMED},
    `artist-credit`: ARRAY<STRUCT<name: STRING, artist: STRUCT<name: STRING, tags: {_NAMED}, genres: {_NAMED}>>>,
    releases: ARRAY<STRUCT<`release-group`: STRUCT<tags: {_NAMED}, genres: {_NAMED}>>>>>>"""
RELEASES = "STRUCT<results: ARRAY<STRUCT<genre: ARRAY<STRING>, style: ARRAY<STRING>>>>"


def page_tags(html: Column, link: str = TAG_LINK) -> Column:
    """Tags linked on a page, decoded, the first of each ignoring case; a null page has none."""
    found = F.regexp_extract_all(html, F.lit(link), F.lit(1))
    decoded = F.transform(found, lambda t: F.regexp_replace(F.replace(url_decoded(t), F.lit("+"), F.lit(" ")), r"(?U)^\s+|\s+$", ""))
    return distinct_ignoring_case(F.filter(or_empty(decoded), lambda t: t != ""))


def _names(things: Column) -> Column:
    names = F.transform(or_empty(things, "struct<name:string>"), lambda t: t["name"])
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def recording_tags(body: Column, artist: Column) -> Column:
    """Tags of the first recording credited to the artist, or to nobody, each once in the
    order recording, artists, release groups. Text that is no such JSON has none."""
    credit_type = f"struct<name:string,artist:struct<name:string,tags:{_NAMED},genres:{_NAMED}>>".replace(": ", ":")

    def with_credits(r: Column) -> Column:
        return F.struct(r.alias("r"), or_empty(r["artist-credit"], credit_type).alias("credits"))

    def credited(x: Column) -> Column:
        joined = F.array_join(F.transform(x["credits"], lambda c: F.coalesce(c["name"], F.lit(""))), "")
        first = F.coalesce(F.get(x["credits"], F.lit(0))["artist"]["name"], F.lit(""))
        return bound(joined, lambda j: F.when(j != "", j).otherwise(first))

    def tags(x: Column) -> Column:
        r = x["r"]
        artists = F.flatten(
            F.transform(x["credits"], lambda c: F.concat(_names(c["artist"]["tags"]), _names(c["artist"]["genres"])))
        )
        groups = F.flatten(
            F.transform(
                or_empty(r["releases"], f"struct<`release-group`:struct<tags:{_NAMED},genres:{_NAMED}>>".replace(": ", ":")),
                lambda g: F.concat(_names(g["release-group"]["tags"]), _names(g["release-group"]["genres"])),
            )
        )
        return F.array_distinct(F.concat(_names(r["tags"]), _names(r["genres"]), artists, groups))

    def fits(x: Column) -> Column:
        return (F.size(x["credits"]) == 0) | bound(credited(x), lambda c: same_artist(artist, c))

    def told(recordings: Column) -> Column:
        return bound(F.get(F.filter(F.transform(recordings, with_credits), fits), F.lit(0)), lambda x: F.when(x.isNotNull(), tags(x)))

    return or_empty(bound(F.from_json(body, RECORDINGS)["recordings"], told))


def release_tags(body: Column) -> Column:
    """Genres, then styles, of the first release found, each once."""
    first = F.get(F.from_json(body, RELEASES)["results"], F.lit(0))
    return F.array_distinct(F.array_compact(F.concat(or_empty(first["genre"]), or_empty(first["style"]))))


def api_tags(rows: DataFrame, keys: list[str], position: str, tag: str, limit: int = 10) -> DataFrame:
    """(keys, tags): the first ``limit`` tags of each key by position; empty names are skipped."""
    order = Window.partitionBy(*keys).orderBy(position, tag)
    kept = rows.where((F.col(tag) != "") & F.col(tag).isNotNull()).withColumn("_n", F.row_number().over(order))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(tag).alias("tag")))), lambda x: x["tag"])
    return kept.where(F.col("_n") <= limit).groupBy(*keys).agg(ordered.alias("tags"))


def most_used_tags(tracks: DataFrame, keys: list[str], tags: str, limit: int = 10) -> DataFrame:
    """(keys, tags): the tags most used over a key's tracks, ties by the tag itself.

    Counts are combined map-side and the window is cut to ``limit`` before its shuffle.
    """
    counts = tracks.select(*keys, F.explode(tags).alias("tag")).where("tag <> ''").groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "tag")
    ranked = counts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_n", "tag"))), lambda x: x["tag"])
    return ranked.groupBy(*keys).agg(ordered.alias("tags"))


def with_fallback(api: Column, mismatch: Column, scraped: Column, scrape_on_mismatch: bool) -> Column:
    """API tags; where there are none the page's. After a mismatch of the artist the page
    is only used for tracks, not for albums and artists."""
    wrong = F.coalesce(mismatch, F.lit(False))
    usable = F.when(wrong, F.array().cast("array<string>")).otherwise(or_empty(api))
    page = or_empty(scraped) if scrape_on_mismatch else F.when(wrong, F.array().cast("array<string>")).otherwise(or_empty(scraped))
    return bound(usable, lambda u: F.when(F.size(u) > 0, u).otherwise(page))


def looked_up(tracks: DataFrame, source: DataFrame, on: dict[str, str], into: str) -> DataFrame:
    """Joins a source of (keys, tags) to tracks on normalised names.

    ``on`` maps columns of tracks to keys of the source. Several source rows of one
    normalised key count once, the smallest of their lists.
    """
    names = [f"_k{i}" for i in range(len(on))]
    keyed = source.groupBy(*[normalised(F.col(k)).alias(n) for n, k in zip(names, on.values())]).agg(F.min("tags").alias(into))
    left = tracks.withColumns({n: normalised(F.col(c)) for n, c in zip(names, on)})
    return left.join(keyed, names, "left").drop(*names)


#: Kinds of a table of tag sources: what their rows are looked up by.
KINDS = {"track": ("artist", "title"), "album": ("artist", "album"), "artist": ("artist",), "recording": ("artist", "title"), "release": ("artist", "title")}


def with_sources(tracks: DataFrame, sources: DataFrame, kinds: list[str]) -> DataFrame:
    """``tracks`` with the columns ``<kind>_tags`` for each wanted kind, null where nothing is known.

    ``sources`` is (kind, artist, name, tags): the name is the title or album, and
    makes no difference for artists.
    """
    for kind in kinds:
        own = sources.where(F.lower("kind") == kind).select("artist", F.col("name").alias(KINDS[kind][-1]) if len(KINDS[kind]) > 1 else F.lit(1), "tags")
        tracks = looked_up(tracks, own, {k: k for k in KINDS[kind]}, f"{kind}_tags")
    return tracks
