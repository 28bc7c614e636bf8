"""The same enrichment over a stream of catalogue rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantera.operators import gates, state
from cantera.plans import enrich as plan


def enrich_stream(tracks: DataFrame, **options) -> DataFrame:
    """Enrichment is a projection, so it needs no state and no watermark."""
    return plan.enrich(tracks, **options)


def newest_only(events: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """The first of repeated rows within the watermark; later ones are dropped with their
    state. The time comes out as TIMESTAMP, which watermarks need."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def upsert_into(store: state.StateStore, overwrite: bool = False, **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: enriches tracks not yet in the store and saves their results.

    A batch that is run again after a failure finds its tracks in the store or
    replaces them by the same rows, so every track is saved once.
    """

    def save(batch: DataFrame, _: int) -> None:
        fresh = gates.unprocessed(batch, store.read(), overwrite)
        fresh = state.last_by_key(fresh.select("rating_key", "title", "artist", "album", "specific_tags", "all_tags", "raw_bpm", "scanned_at"),
                                  "rating_key", ["scanned_at", "title", "artist", "album", "raw_bpm"])
        store.save(plan.results(plan.enrich(fresh, **options), F.coalesce("scanned_at", F.lit("1970-01-01").cast("timestamp_ntz"))))

    return save
