"""One query for each operator, over whole tables. Lists come out as text joined by ``|``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.functions.text import bound, normalised, or_empty, strings, url_encoded
from cantera.operators import audio, embedding, gates, genre, matcher, merge, moods, sinks, state
from cantera.operators.text_pass import with_text
from cantera.plans import enrich as plan
from cantera.plans import library as lib
from cantera.session import table
from cantera.sources import catalog, payloads, requests

#: Tracks take the predictions of so many recordings in turn.
RECORDINGS = 50
#: Styles that exclude another.
EXCLUDING = {style for pair in matcher.SUB.exclusive for style in pair}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(values: Column) -> Column:
    return F.array_join(values, "|")


def tags_of(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "track_items").select("row_id", "raw_tags", *more)


def _tagged(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The library's columns that enrichment reads; the Arrow pass carries what it is given."""
    return lib.library(spark, d).select("row_id", "artist", "album", *lib.SOURCES, "raw_bpm", *more)


def _enriched(rows: DataFrame, **options) -> DataFrame:
    return plan.enrich(rows, every=lib.SOURCES, **options)


@query
def flagship_enrich(spark: SparkSession, d: str) -> DataFrame:
    out = _enriched(_tagged(spark, d))
    return out.select("row_id", "genre", joined("sub_genres").alias("sub_genres"), "bpm", joined("moods").alias("moods"),
                      "mapped_mood", "confidence")


@query
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return plan.run_summary(_enriched(_tagged(spark, d)))


@query
def before_after_report(spark: SparkSession, d: str) -> DataFrame:
    out = plan.report(_enriched(_tagged(spark, d, "title", "current_moods")).withColumn("rating_key", F.col("row_id").cast("string")))
    return out.select("rating_key", "genres_before", "genres_after", "moods_before", "moods_after", "bpm_after")


# Tag sources and unions


@query
def tag_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    return lib.library(spark, d).select("row_id", joined("all_tags").alias("tags"))


@query
def api_top10_tags(spark: SparkSession, d: str) -> DataFrame:
    tracks = tags_of(spark, d, normalised(F.col("artist")).alias("artist_key"))
    top = payloads.most_used_tags(tracks, ["artist_key"], "raw_tags")
    return top.select("artist_key", joined("tags").alias("tags"))


@query
def api_ranked_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = tags_of(spark, d, F.posexplode("raw_tags").alias("pos", "tag"))
    return payloads.api_tags(rows, ["row_id"], "pos", "tag", limit=3).select("row_id", joined("tags").alias("tags"))


@query
def source_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Artist tags of the catalogue looked up by the credits of the result table."""
    tracks = tags_of(spark, d, "artist")
    source = payloads.most_used_tags(tracks, ["artist"], "raw_tags")
    results = table(spark, d, "processed_tracks").select("result_id", "artist")
    found = payloads.looked_up(results, source, {"artist": "artist"}, "tags")
    return found.select("result_id", joined("tags").alias("tags"))


@query
def source_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tag_writes").select(
        "write_id",
        joined(payloads.with_fallback(F.col("genres"), F.col("overwrite_tags"), F.col("moods"), True)).alias("track_tags"),
        joined(payloads.with_fallback(F.col("genres"), F.col("overwrite_tags"), F.col("moods"), False)).alias("artist_tags"),
    )
    return rows


@query
def html_tag_scrape(spark: SparkSession, d: str) -> DataFrame:
    def link(tag: Column) -> Column:
        return F.concat(F.lit('<li><a href="https://tags.example/tag/'), url_encoded(tag), F.lit('">'), tag, F.lit("</a></li>"))

    page = F.concat(F.lit("<ul>"), F.array_join(F.transform(or_empty(F.col("raw_tags")), link), "\n"), F.lit("</ul>"))
    return tags_of(spark, d).select("row_id", joined(payloads.page_tags(page)).alias("tags"))


def _named(values: str) -> Column:
    return F.transform(or_empty(F.col(values)), lambda x: F.struct(x.alias("name")))


@query
def recording_json_tags(spark: SparkSession, d: str) -> DataFrame:
    """Answers with two recordings: one by somebody else, one by the artist with a guest."""
    tracks = tags_of(spark, d, "current_moods", "artist")

    def recording(credit: Column, tags: Column, genres: Column) -> Column:
        return F.struct(tags.alias("tags"), genres.alias("genres"), F.array(F.struct(credit.alias("name"))).alias("artist-credit"))

    other = recording(F.lit("Nobody At All"), _named("current_moods"), _named("raw_tags"))
    own = recording(F.concat(normalised(F.col("artist")), F.lit(" feat. A Guest")), _named("raw_tags"), _named("current_moods"))
    body = F.to_json(F.struct(F.array(other, own).alias("recordings")))
    return tracks.select("row_id", joined(payloads.recording_tags(body, F.col("artist"))).alias("tags"))


@query
def release_json_tags(spark: SparkSession, d: str) -> DataFrame:
    release = F.struct(F.col("genres").alias("genre"), F.col("moods").alias("style"))
    body = F.to_json(F.struct(F.array(release).alias("results")))
    return table(spark, d, "tag_writes").select("write_id", joined(payloads.release_tags(body)).alias("tags"))


@query
def lookup_requests(spark: SparkSession, d: str) -> DataFrame:
    base, artist, title = "https://tags.example", F.col("artist"), F.col("title")
    return table(spark, d, "track_items").select(
        "row_id", requests.page_url(base, artist).alias("artist_page"), requests.page_url(base, artist, album=F.col("album")).alias("album_page"),
        requests.page_url(base, artist, title=title).alias("track_page"), requests.recording_url(f"{base}/recording", artist, title).alias("recording"),
        requests.release_url(f"{base}/search", artist, title, "secret").alias("release"),
    )


#: (kind, number, body, artist, tags): answers as services give them on bad days, and what is to come of them.
PAYLOADS = (
    ("page", 1, '<a href="/tag/50%25+off">x</a> <a href="/tag/50%">y</a><a href="/tag/caf%C3%A9">', "", "50% off|50%|café"),
    ("page", 2, '<a href="/tag/a?x=1">A</a><a href="/tag/A">a</a><a href="/tag/">', "", "a"),
    ("page", 3, None, "", ""),
    ("recording", 1, '{"recordings": [{"tags": [{"name": "x"}, {"name": ""}, {}]}]}', "Quell", "x"),
    ("recording", 2, '{"recordings": [{"artist-credit": [{"name": "Other"}], "tags": [{"name": "x"}]}]}', "Quell", ""),
    ("recording", 3, '{"recordings": [{"artist-credit": [{"artist": {"name": "The Quell", "genres": [{"name": "g"}]}}],'
     ' "releases": [{"release-group": {"tags": [{"name": "r"}, {"name": "g"}]}}]}]}', "quell ", "g|r"),
    ("recording", 4, "{not json", "Quell", ""),
    ("recording", 5, '{"recordings": []}', "Quell", ""),
    ("recording", 6, None, "Quell", ""),
    ("release", 1, '{"results": [{"genre": ["Rock", "Pop"], "style": ["Pop", "Emo"]}, {"genre": ["Jazz"]}]}', "", "Rock|Pop|Emo"),
    ("release", 2, '{"results": [{"style": null}]}', "", ""),
    ("release", 3, "[]", "", ""),
)


@query
def awkward_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Fixed answers with missing credits, broken JSON and stray percent signs."""
    rows = spark.createDataFrame([p[:4] for p in PAYLOADS], "kind string, number int, body string, artist string")
    tags = (
        F.when(F.col("kind") == "page", payloads.page_tags(F.col("body")))
        .when(F.col("kind") == "recording", payloads.recording_tags(F.col("body"), F.col("artist")))
        .otherwise(payloads.release_tags(F.col("body")))
    )
    return rows.select("kind", "number", F.coalesce(joined(tags), F.lit("")).alias("tags"))


@query
def catalog_export(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue written out as a server's export and read back as track items."""
    export = table(spark, d, "track_items").select(
        F.col("row_id").cast("string").alias("ratingKey"), "title",
        F.when(F.col("row_id") % 2 == 0, F.col("artist")).otherwise("").alias("grandparentTitle"),
        F.col("artist").alias("originalTitle"), F.col("album").alias("parentTitle"),
        F.transform("current_moods", lambda m: F.struct(m.alias("tag"))).alias("moods"),
        F.when(F.col("file_path").isNotNull(), F.array(F.struct(F.array(F.struct(F.col("file_path").alias("file"))).alias("parts")))).alias("media"),
    )
    text = export.select(F.to_json(F.struct("*")).alias("value"))
    items = catalog.from_export(text.select(F.from_json("value", catalog.EXPORT).alias("e")).select("e.*"))
    return items.withColumn("current_moods", joined("current_moods"))


# Filters and gates


@query
def genre_keyword_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return tags_of(spark, d).select("row_id", joined(gates.genre_tags(F.col("raw_tags"))).alias("tags"))


@query
def subgenre_generic_filter(spark: SparkSession, d: str) -> DataFrame:
    return lib.library(spark, d).select("row_id", joined(gates.style_tags(F.col("all_tags"))).alias("tags"))


def _gated(rows: DataFrame) -> DataFrame:
    kept = with_text(rows.select("row_id", "artist", "album", "all_tags"), "all_tags", gate="tags")
    return kept.select("row_id", joined("tags").alias("tags"))


@query
def mood_tag_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gated(lib.library(spark, d))


@query
def taxonomy_mood_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gated(lib.drawn_library(spark, d))


@query
def mood_gate_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    tags = tags_of(spark, d, "artist", "album").select("artist", "album", F.explode("raw_tags").alias("tag"))
    reason = gates.mood_tag_reason(F.col("tag"), F.col("artist"), F.col("album"))
    return tags.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n_tags"))


@query
def artist_substring_filter(spark: SparkSession, d: str) -> DataFrame:
    return gates.by_artist(table(spark, d, "track_items").select("row_id", "artist"), "Orchestra")


@query
def artist_identity(spark: SparkSession, d: str) -> DataFrame:
    tracks = table(spark, d, "track_items").select("rating_key", "row_id", F.col("artist").alias("expected"))
    results = table(spark, d, "processed_tracks").select("rating_key", "result_id", F.col("artist").alias("candidate"))
    same = gates.same_artist(F.col("expected"), F.col("candidate"))
    return tracks.join(results, "rating_key").select("row_id", "result_id", same.alias("same_artist"))


@query
def path_remap(spark: SparkSession, d: str) -> DataFrame:
    path = gates.remapped(F.col("file_path"), "/srv/tunes", "/mnt/library")
    return table(spark, d, "track_items").select("row_id", path.alias("path"))


@query
def existing_files(spark: SparkSession, d: str) -> DataFrame:
    tracks = table(spark, d, "track_items").select("row_id", "file_path")
    here, gone = gates.present(tracks, table(spark, d, "tag_writes"), "file_path")
    return here.select("row_id", F.lit(True).alias("present")).unionByName(gone.select("row_id", F.lit(False).alias("present")))


@query
def unprocessed_tracks(spark: SparkSession, d: str) -> DataFrame:
    tracks = table(spark, d, "track_items").select("row_id", "rating_key")
    return gates.unprocessed(tracks, table(spark, d, "processed_tracks"))


@query
def limited_tracks(spark: SparkSession, d: str) -> DataFrame:
    return gates.chosen(table(spark, d, "track_items").select("row_id", "title"), limit=100, key="row_id")


@query
def random_sample_limit(spark: SparkSession, d: str) -> DataFrame:
    return gates.chosen(table(spark, d, "track_items").select("row_id", "title"), limit=100, seed=7, key="row_id")


# Matching


def _exploded(rows: DataFrame, tags: str, vocabulary: matcher.Vocabulary, k: int = 3) -> DataFrame:
    found = matcher.match_lists(rows.select("row_id", tags), {"found": ((tags,), vocabulary)}, k)
    out = found.select("row_id", F.posexplode("found").alias("pos", "m"))
    return out.select("row_id", F.col("pos").alias("place"), "m.target", "m.raw", F.round("m.score", 6).alias("score"))


@query
def lexical_match_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = lib.library(spark, d)
    hits = rows.select("row_id", F.explode(matcher.lexical_hits(F.col("all_tags"), matcher.SUB)).alias("h"))
    return hits.select("row_id", "h.target", "h.raw", "h.rank", F.round("h.score", 6).alias("score"))


@query
def primary_genre_matches(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(tags_of(spark, d), "raw_tags", matcher.PRIMARY)


@query
def subgenre_matches(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(lib.library(spark, d), "all_tags", matcher.SUB)


@query
def taxonomy_subgenre_matches(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(lib.drawn_library(spark, d), "all_tags", matcher.SUB)


@query
def style_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Matches left after the better of two excluding styles has been kept."""
    plain = matcher.Vocabulary(matcher.SUB.targets, vectors=False)
    return _exploded(lib.drawn_library(spark, d), "all_tags", plain, k=len(matcher.SUB.targets))


@query
def consensus_gate(spark: SparkSession, d: str) -> DataFrame:
    """Matches kept to those of the first three tags, where these have any."""
    apart = matcher.Vocabulary(tuple(t for t in matcher.SUB.targets if t not in EXCLUDING), vectors=False, consensus=True)
    return _exploded(lib.drawn_library(spark, d), "all_tags", apart, k=len(apart.targets))


@query
def mood_lexical_matches(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_mood_lists(spark, d), "moods", matcher.MOODS)


@query
def taxonomy_mood_matches(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(lib.drawn_library(spark, d), "all_tags", matcher.MOODS)


@query
def mood_vector_matches(spark: SparkSession, d: str) -> DataFrame:
    """Moods named by letters or reached by vectors, those of a small embedder."""
    rows = _mood_lists(spark, d).select("row_id", "moods")
    rows = embedding.with_similarity(rows, "moods", matcher.MOODS, lib.LetterCounts, digits=6)
    found = matcher.match_tags(F.col("moods"), matcher.MOODS, k=3, similarity=F.col("similarity"), threshold=0.8)
    out = rows.select("row_id", F.posexplode(found).alias("place", "m"))
    return out.select("row_id", "place", "m.target", "m.raw", F.round("m.score", 6).alias("score"))


@query
def mood_tag_matches(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(lib.library(spark, d), "all_tags", matcher.MOOD_TAGS, k=5)


@query
def primary_genre_vote(spark: SparkSession, d: str) -> DataFrame:
    return with_text(lib.library(spark, d).select("row_id", "all_tags"), every="all_tags", genre="genre").select("row_id", "genre")


def _styled(spark: SparkSession, d: str, drawn: bool = False) -> DataFrame:
    rows, every = (lib.drawn_library(spark, d), "all_tags") if drawn else (lib.library(spark, d), lib.SOURCES)
    rows = rows.select("row_id", "artist", "album", "raw_bpm", *(("specific_tags", "all_tags") if drawn else lib.SOURCES))
    rows = with_text(rows, "specific_tags", every, genre="genre", styles="sub_genres")
    return rows.withColumn("bpm", audio.whole_bpm(F.col("raw_bpm")))


@query
def subgenre_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _styled(spark, d).select("row_id", joined("sub_genres").alias("sub_genres"))


@query
def genre_elevation(spark: SparkSession, d: str) -> DataFrame:
    return _styled(spark, d).select("row_id", genre.elevated(F.col("genre"), F.col("sub_genres")).alias("genre"))


@query
def taxonomy_genre_elevation(spark: SparkSession, d: str) -> DataFrame:
    return _styled(spark, d, drawn=True).select("row_id", genre.elevated(F.col("genre"), F.col("sub_genres")).alias("genre"))


@query
def genre_list(spark: SparkSession, d: str) -> DataFrame:
    return _styled(spark, d).select("row_id", joined(genre.genre_list(F.col("genre"), F.col("sub_genres"))).alias("genres"))


# Moods


@query
def seeded_moods(spark: SparkSession, d: str) -> DataFrame:
    return _styled(spark, d).select("row_id", joined(moods.seeded_moods(F.col("sub_genres"))).alias("moods"))


def _mooded(spark: SparkSession, d: str, drawn: bool = False) -> DataFrame:
    """Styled rows with text moods and the predictions of one of the first recordings."""
    tops = lib.recordings(spark, d).select("key", "top", audio.audio_moods(F.col("top"), F.lit(None).cast("int"), labels=lib.LABELS).alias("heard"))
    rows = _styled(spark, d, drawn).withColumn("key", (F.col("row_id") % RECORDINGS).cast("int"))
    rows = rows.join(tops, "key", "left")
    rows = moods.with_text_moods(rows, "specific_tags", "text")
    audible = F.when(F.col("row_id") % 3 != 0, F.col("heard.accepted"))
    return rows.withColumn("audio", or_empty(audible))


@query
def text_moods(spark: SparkSession, d: str) -> DataFrame:
    return _mooded(spark, d).select("row_id", joined("text").alias("moods"))


@query
def seed_admission(spark: SparkSession, d: str) -> DataFrame:
    seeds = moods.seeded_moods(F.col("sub_genres"))
    kept = moods.admitted_seeds(seeds, F.col("text"), F.col("audio"), F.col("sub_genres"), F.col("bpm"), F.col("top"))
    return _mooded(spark, d).select("row_id", joined(kept).alias("moods"))


def _mood_lists(spark: SparkSession, d: str) -> DataFrame:
    """The moods and tags stored with each track as one list, with the last tempo."""
    names = F.array_distinct(F.array_compact(F.concat(or_empty(F.col("current_moods")), or_empty(F.col("raw_tags")))))
    rows = tags_of(spark, d, "rating_key", "current_moods").withColumn("moods", names)
    rows = rows.join(lib.latest_tempo(spark, d), "rating_key", "left")
    return rows.select("row_id", "moods", audio.whole_bpm(F.col("raw_bpm")).alias("bpm"))


@query
def tempo_mood_rules(spark: SparkSession, d: str) -> DataFrame:
    return _mood_lists(spark, d).select("row_id", joined(moods.tempo_checked(F.col("moods"), F.col("bpm"))).alias("moods"))


@query
def mood_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return _mood_lists(spark, d).select("row_id", joined(moods.without_conflicts(F.col("moods"))).alias("moods"))


@query
def mood_priority_order(spark: SparkSession, d: str) -> DataFrame:
    return _mood_lists(spark, d).select("row_id", joined(moods.specific_first(F.col("moods"))).alias("moods"))


def _final(rows: DataFrame) -> DataFrame:
    final = moods.final_moods(F.col("text"), F.col("sub_genres"), F.col("audio"), F.col("bpm"), F.col("top"))
    rows = rows.select("row_id", final.alias("moods"))
    return rows.select("row_id", joined("moods").alias("moods"), moods.primary_mood(F.col("moods")).alias("mapped_mood"))


@query
def primary_mood(spark: SparkSession, d: str) -> DataFrame:
    return _final(_mooded(spark, d))


@query
def taxonomy_primary_mood(spark: SparkSession, d: str) -> DataFrame:
    return _final(_mooded(spark, d, drawn=True))


# Audio


@query
def audio_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return lib.predictions(spark, d).withColumn("class", F.col("class").cast("int"))


@query
def audio_top10(spark: SparkSession, d: str) -> DataFrame:
    return audio.top_classes(lib.predictions(spark, d), "key").select("key", "rank", F.col("class").cast("int").alias("class"), "score")


TEMPI = (None, 90, 112, 116, 121, 125, 130)


def _heard(spark: SparkSession, d: str) -> DataFrame:
    """Each recording's predictions at several tempi."""
    tempi = F.array(*[F.lit(t).cast("int") for t in TEMPI])
    return lib.recordings(spark, d).select("key", "top", F.explode(tempi).alias("bpm"))


@query
def audio_confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    kept = F.transform(audio.confident(F.col("top")), lambda p: p["label"])
    return lib.recordings(spark, d).select("key", joined(kept).alias("labels"))


@query
def audio_mood_map(spark: SparkSession, d: str) -> DataFrame:
    found = bound(audio.confident(F.col("top")), lambda c: audio.label_moods(c))
    return lib.recordings(spark, d).select("key", joined(found).alias("moods"))


@query
def audio_tempo_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = _mood_lists(spark, d)
    return rows.select("row_id", joined(audio.tempo_valid(F.col("moods"), F.col("bpm"))).alias("moods"))


@query
def audio_standalone_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = _mood_lists(spark, d)
    return rows.select("row_id", joined(audio.supported(F.col("moods"), F.col("bpm"))).alias("moods"))


@query
def audio_matched_score(spark: SparkSession, d: str) -> DataFrame:
    rows = _heard(spark, d).withColumn("r", audio.audio_moods(F.col("top"), F.col("bpm"), labels=lib.LABELS))
    return rows.select("key", "bpm", joined("r.moods").alias("moods"), F.round("r.score", 6).alias("score"), joined("r.accepted").alias("accepted"))


@query
def audio_genre_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = lib.genre_recordings(spark, d).withColumn("r", audio.audio_genres(F.col("genre_top")))
    return rows.select("key", F.col("r.genre").alias("genre"), joined("r.sub_genres").alias("sub_genres"))


@query
def audio_genre_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Genre and styles with audio predictions to fall back on where the tags name no genre."""
    rows = _tagged(spark, d).withColumn("key", (F.col("row_id") % RECORDINGS).cast("int"))
    rows = rows.join(lib.genre_recordings(spark, d), "key", "left")
    out = _enriched(rows, features=plan.Features(mood=False, bpm=False), genre_top="genre_top")
    return out.select("row_id", "genre", joined("sub_genres").alias("sub_genres"))


@query
def audio_unlabelled_mood(spark: SparkSession, d: str) -> DataFrame:
    scores = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", joined(audio.unlabelled_mood(scores)).alias("moods"))


@query
def bpm_half_even(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tempo_readings").select("reading_id", audio.whole_bpm(F.col("raw_bpm")).alias("bpm"))


# Vectors


def _centres(spark: SparkSession, d: str) -> DataFrame:
    """One row: the sum of each label's vectors, in whole millionths, by label."""
    cells = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    sums = cells.groupBy("label", "dim").agg(F.sum(F.round(F.col("x").cast("double") * 1e6).cast("bigint")).alias("s"))
    vectors = sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", F.col("s").cast("double").alias("s")))).alias("v"))
    vectors = vectors.select("label", F.transform("v", lambda c: c["s"]).alias("v"))
    return vectors.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "v"))), lambda r: r["v"]).alias("centres"))


@query
def cosine_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    centres = [c[0] for c in _centres(spark, d).select(F.explode("centres")).collect()]  # one vector for each label
    return embedding.cosines(rows, "vec_id", "embedding", centres).withColumn("cosine", F.round("cosine", 5))


TARGETS = tuple(f"target {i}" for i in range(10))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """Ordered lists of eight vectors, as if they were tags, with their cosines to the centres."""
    rows = table(spark, d, "embeddings").withColumn("grp", F.floor(F.col("vec_id") / 8).cast("int"))
    lists = rows.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("t"))
    lists = lists.crossJoin(F.broadcast(_centres(spark, d)))  # one row
    tags = F.transform("t", lambda x: F.concat(F.lit("tag "), x["vec_id"].cast("string")))
    sims = matcher.similarities(F.transform("t", lambda x: x["embedding"]), F.col("centres"))
    return lists.select("grp", tags.alias("tags"), F.transform(sims, lambda s: F.transform(s, lambda x: F.round(x, 6))).alias("sims"))


@query
def best_pair_match(spark: SparkSession, d: str) -> DataFrame:
    pair = matcher.best_pair(F.col("tags"), matcher.Vocabulary(TARGETS), F.col("sims"), threshold=0.3)
    return _compared(spark, d).select("grp", pair.alias("p")).select("grp", "p.accepted", "p.best", "p.raw", "p.score")


@query
def rank_weighted_similarity(spark: SparkSession, d: str) -> DataFrame:
    found = matcher.match_tags(F.col("tags"), matcher.Vocabulary(TARGETS), k=3, similarity=F.col("sims"), threshold=0.2)
    rows = _compared(spark, d).select("grp", F.posexplode(found).alias("place", "m"))
    return rows.select("grp", "place", "m.target", "m.raw", F.round("m.score", 8).alias("score"))


# Merges and state


@query
def write_if_empty(spark: SparkSession, d: str) -> DataFrame:
    args = [F.col(c) for c in ("existing", "genres", "moods", "bpm", "overwrite_tags")]
    fields = merge.merged_fields(*args)
    changed = merge.file_modified(F.col("file_path"), *args)
    return table(spark, d, "tag_writes").select(
        "write_id", *[joined(v).alias(f"{k}_after") for k, v in fields.items()], changed.alias("changed"), "modified"
    )


@query
def frame_merge(spark: SparkSession, d: str) -> DataFrame:
    """What is written to which frame, when files hold their fields in the frames of their kind."""
    writes = merge.frame_writes(
        F.col("file_path"), merge.held_frames(F.col("file_path"), F.col("existing")), F.col("genres"), F.col("moods"), F.col("bpm"), F.col("overwrite_tags")
    )
    out = table(spark, d, "tag_writes").select("write_id", F.explode(writes).alias("w"))
    return out.select("write_id", "w.frame", joined("w.values").alias("values"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    old = {f"old_{f}": F.try_element_at("existing", F.lit(f)) for f in ("genre", "mood")}
    bpm = F.try_element_at(F.try_element_at("existing", F.lit("bpm")), F.lit(1)).try_cast("int")
    return table(spark, d, "tag_writes").withColumns({**old, "old_bpm": bpm})


@query
def catalog_sync(spark: SparkSession, d: str) -> DataFrame:
    names = ("old_genre", "genres", "old_mood", "moods", "old_bpm", "bpm", "overwrite_tags")
    edits = _held(spark, d).select("write_id", sinks.catalog_edits(*map(F.col, names)).alias("e")).select("write_id", "e.*")
    return edits.withColumns({c: joined(c) for c, kind in edits.dtypes if kind.startswith("array")})


@query
def catalog_mood_overwrite(spark: SparkSession, d: str) -> DataFrame:
    edits = _held(spark, d).select("write_id", sinks.single_mood(F.get("moods", F.lit(0)), F.col("old_mood")).alias("e"))
    return edits.select("write_id", joined("e.remove_moods").alias("removed"), joined("e.add_moods").alias("added"), "e.lock_moods")


@query
def file_sink_gates(spark: SparkSession, d: str) -> DataFrame:
    exists = F.col("file_path").isNotNull() & F.col("modified")
    done = {name: sinks.file_accepts(F.col("file_path"), exists, **how) for name, how in
            {"written": {}, "in_dry_run": {"dry_run": True}, "when_disabled": {"enabled": False}}.items()}
    return table(spark, d, "tag_writes").select("write_id", *[v.alias(k) for k, v in done.items()])


@query
def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    """Tempo written to the catalogue where it has none or 0, moods where it has none."""
    writes = table(spark, d, "tag_writes")
    old_bpm = F.try_element_at(F.try_element_at("existing", F.lit("bpm")), F.lit(1)).try_cast("int")
    old_moods = F.try_element_at("existing", F.lit("mood"))
    return writes.select(
        "write_id", merge.merged_number(F.col("bpm"), old_bpm, F.col("overwrite_tags")).alias("bpm"),
        joined(merge.merged_list(F.col("moods"), old_moods, F.col("overwrite_tags"))).alias("moods"),
    )


@query
def mood_command(spark: SparkSession, d: str) -> DataFrame:
    command = merge.mood_command(F.col("file_path"), F.col("moods"))
    return table(spark, d, "tag_writes").select("write_id", F.array_join(command, " ").alias("command"))


@query
def state_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Results of the audio runs, then those of all other runs put over them."""
    rows = table(spark, d, "processed_tracks").select("rating_key", "result_id", "mapped_mood", "processed_at", "source")
    rows = rows.withColumn("at", F.coalesce(F.col("processed_at"), F.lit("1970-01-01").cast("timestamp_ntz")))
    first = state.last_by_key(rows.where("lower(source) = 'audio'"), "rating_key", ["at", "result_id"])
    merged = state.upsert(first, rows.where("lower(source) <> 'audio'"), "rating_key", ["at", "result_id"])
    return merged.select("rating_key", "result_id", "mapped_mood")


@query
def state_stats(spark: SparkSession, d: str) -> DataFrame:
    return state.state_stats(table(spark, d, "processed_tracks"))
