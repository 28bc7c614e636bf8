"""Command line: enrich a catalogue, show the state, write settings.

    python -m cantera.cli enrich --catalog tracks.parquet --sources tags.parquet --state state/ --output out/
    python -m cantera.cli status --state state/
    python -m cantera.cli setup --set processing.batch_size=500
    python -m cantera.cli wizard

Tracks are enriched and committed in batches. Each batch is a folder of the output, named after
the version of the state it was committed with: earlier ones are never touched, and what an
interrupted run had not committed is written again by the next one.
"""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.functions.text import or_empty
from cantera.operators import gates, genre, merge, sinks
from cantera.operators.matcher import MOOD_TAGS, Vocabulary
from cantera.operators.state import StateStore
from cantera.plans import enrich as plan
from cantera.sources import catalog, config, payloads

#: Commits a run makes at most: each reads the catalogue once.
MOST_BATCHES = 50
OPTIONAL = (
    ("raw_tags", "array<string>"), ("current_moods", "array<string>"), ("current_genres", "array<string>"), ("current_bpm", "int"),
    ("raw_bpm", "double"), ("album", "string"), ("file_path", "string"),
)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cantera")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("enrich", "analyze"):
        p = commands.add_parser(name, help="work out genres, moods and tempo of new tracks")
        p.add_argument("--config", "-c")
        p.add_argument("--catalog", help="Parquet of track items with raw_tags, or a JSON export")
        p.add_argument("--sources", help="Parquet of (kind, artist, name, tags): tags of tracks, albums, artists, recordings, releases")
        p.add_argument("--predictions", help="Parquet of (rating_key, mood_top, genre_top): what audio models say")
        p.add_argument("--existing", help="Parquet of (file_path, existing): the fields that files hold now")
        p.add_argument("--state")
        p.add_argument("--output", "-o", help="folder for the enriched tracks, a folder in it for each batch")
        p.add_argument("--files", help="only tracks whose file lies under this folder")
        p.add_argument("--artist", "-a")
        p.add_argument("--limit", "-l", type=int)
        p.add_argument("--batch-size", "-b", type=int, help=f"tracks committed at once, more if there were over {MOST_BATCHES} batches")
        p.add_argument("--random", "-r", type=int, nargs="?", const=1, metavar="SEED")
        for flag in (
            "--dry-run", "--overwrite", "--write-tags", "--overwrite-tags", "--sync", "--verbose", "--genre", "--subgenre", "--mood", "--bpm",
        ):
            p.add_argument(flag, action="store_true")
    status = commands.add_parser("status", help="counts of the state")
    status.add_argument("--config", "-c")
    status.add_argument("--state")
    for name in ("setup", "wizard"):
        p = commands.add_parser(name, help="write settings, others stay; without --set they are asked for")
        p.add_argument("--config", "-c", default="config.yaml")
        p.add_argument("--set", action="append", default=[], metavar="SECTION.KEY=VALUE")
    return top


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    tracks = catalog.read_export(spark, path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return tracks.withColumns({name: F.lit(None).cast(kind) for name, kind in OPTIONAL if name not in tracks.columns})


def tagged(spark: SparkSession, tracks: DataFrame, args: argparse.Namespace, settings: config.Settings) -> DataFrame:
    """Tracks with the tags of their own and those of all sources. Without a table of sources
    ``all_tags`` is the catalogue's, or else its ``raw_tags``."""
    own = or_empty(F.array_compact("raw_tags"))
    if not args.sources:
        every = F.col("all_tags") if "all_tags" in tracks.columns else F.col("raw_tags")
        return tracks.withColumns({"specific_tags": own, "all_tags": genre.tag_union(every)})
    kinds = ["track", "album", "artist", *(["recording"] if settings.recordings.enabled else []), *(["release"] if settings.releases.api_token else [])]
    tracks = payloads.with_sources(tracks, spark.read.parquet(args.sources), kinds)
    specific = F.concat(own, *(or_empty(F.array_compact(f"{k}_tags")) for k in kinds if k in ("track", "recording")))
    every = genre.tag_union(own, *(F.col(f"{k}_tags") for k in kinds))
    return tracks.withColumns({"specific_tags": specific, "all_tags": every}).drop(*(f"{k}_tags" for k in kinds))


def chosen(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> DataFrame:
    """The tracks to process, with their tags and predictions."""
    processing = settings.processing
    tracks = gates.by_artist(read_catalog(spark, args.catalog or settings.catalog.path), args.artist)
    path = gates.remapped(F.col("file_path"), processing.path_map_source, processing.path_map_target)
    tracks = tracks.withColumn("resolved_path", path)
    if args.files:
        tracks, _ = gates.present(tracks, catalog.file_listing(spark, args.files).withColumnRenamed("path", "resolved_path"), "resolved_path")
    state = StateStore(spark, args.state or settings.state.path)
    tracks = gates.unprocessed(tracks, state.read(), args.overwrite or processing.overwrite)
    tracks = tagged(spark, gates.chosen(tracks, args.limit, args.random), args, settings)
    if args.predictions and settings.audio.enabled:
        heard = spark.read.parquet(args.predictions).groupBy("rating_key").agg(F.min("mood_top").alias("mood_top"), F.min("genre_top").alias("genre_top"))
        tracks = tracks.join(heard, "rating_key", "left")
    return tracks


def enrich(spark: SparkSession, tracks: DataFrame, args: argparse.Namespace, settings: config.Settings) -> DataFrame:
    """The tracks enriched, with what is to be written where it was asked for; nothing runs yet."""
    mapping = settings.mapping
    vocabulary = Vocabulary(mapping.target_moods) if mapping.target_moods else MOOD_TAGS
    features = plan.Features.chosen(args.genre, args.subgenre, args.mood, args.bpm)
    heard = {name: name for name in ("mood_top", "genre_top") if name in tracks.columns}
    out = plan.enrich(tracks, features, vocabulary, threshold=mapping.mood_threshold, audio_threshold=settings.audio.threshold, **heard)
    overwrite = F.lit(args.overwrite_tags)
    if args.write_tags and settings.files.enabled:
        held = F.lit(None).cast("map<string,array<string>>")
        if args.existing:
            files = spark.read.parquet(args.existing).where("file_path <> ''").groupBy("file_path").agg(F.max_by("existing", F.size("existing")).alias("existing"))
            out = out.join(files, "file_path", "left")
            held = F.col("existing")
        frames = merge.held_frames(F.col("resolved_path"), held)
        out = out.withColumn("writes", merge.frame_writes(F.col("resolved_path"), frames, F.col("genres"), F.col("moods"), F.col("bpm"), overwrite))
    if args.sync:
        names = ("current_genres", "genres", "current_moods", "moods", "current_bpm", "bpm")
        out = out.withColumn("edits", sinks.catalog_edits(*map(F.col, names), overwrite))
    if settings.command.enabled and features.mood:
        out = out.withColumn("command", merge.mood_command(F.col("resolved_path"), F.col("moods"), settings.command.binary_path))
    return out


def batches(tracks: DataFrame, size: int) -> list[DataFrame]:
    """The tracks in parts of about ``size``, at most ``MOST_BATCHES``; rows of one key go together."""
    n = min(MOST_BATCHES, -(-tracks.count() // max(size, 1)))
    if n <= 1:
        return [tracks] * n
    part = F.pmod(F.xxhash64("rating_key"), F.lit(n))
    return [tracks.where(part == i) for i in range(n)]


def run(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> None:
    if args.write_tags and settings.files.enabled and not args.overwrite_tags and not args.existing:
        raise SystemExit("--write-tags writes only what is empty: name what files hold by --existing, or give --overwrite-tags")
    state = StateStore(spark, args.state or settings.state.path)
    tracks = chosen(spark, args, settings)
    if args.dry_run or settings.processing.dry_run:
        out = enrich(spark, tracks, args, settings)
        if args.verbose:
            plan.report(out).show(50, truncate=False)
        plan.run_summary(out).show()
        return
    limited = args.limit is not None or args.random is not None
    done = []
    # what a limit chooses changes with the state, so it is one batch
    for batch in [tracks] if limited else batches(tracks, args.batch_size or settings.processing.batch_size):
        version = state.next_version()
        folder = f"{(args.output or f'{state.path}/_enriched').rstrip('/')}/batch={version}"
        enrich(spark, batch, args, settings).write.mode("overwrite").parquet(folder)  # only what no state names is written over
        out = spark.read.parquet(folder)
        state.save(plan.results(out, F.lit(datetime.now(UTC).replace(tzinfo=None))), compact=False)  # later batches read the first state
        done.append(folder)
    state.compact()
    if not done:
        print("nothing to do")
        return
    out = spark.read.parquet(*done)
    if args.verbose:
        plan.report(out).show(50, truncate=False)
    plan.run_summary(out).show()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command in ("setup", "wizard"):
        if not args.set:
            config.wizard(args.config)
            return 0
        answers: dict[str, dict] = {}
        for item in args.set:
            key, _, value = item.partition("=")
            section, _, name = key.partition(".")
            answers.setdefault(section, {})[name] = config.parsed(value)
        config.save(answers, args.config)
        return 0
    settings = config.load(args.config)
    spark = spark or SparkSession.builder.appName("cantera").getOrCreate()
    if args.command == "status":
        StateStore(spark, args.state or settings.state.path).stats().show()
    else:
        run(spark, args, settings)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
