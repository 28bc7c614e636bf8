"""What is written back to a catalogue and to files, as tables of edits.

The rules are projections; a plug-in that talks to a server or to files gets each edit
once, in the tasks that hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.functions.text import extension, or_empty
from cantera.operators.merge import FRAMES, writes_list, writes_number

_NONE = "array<string>"


def catalog_edits(
    old_genres: Column, genres: Column, old_moods: Column, moods: Column, old_bpm: Column, bpm: Column, overwrite: Column
) -> Column:
    """STRUCT<remove_genres, add_genres, remove_moods, add_moods, lock_moods, bpm>.

    Lists are written where the old one is empty; when overwriting, the old values are
    removed first. Moods that are written are locked. The tempo is written where it is
    missing or 0, or when overwriting.
    """
    nothing = F.array().cast(_NONE)

    def both(new: Column, old: Column) -> tuple[Column, Column]:
        writes = writes_list(new, old, overwrite)
        removed = F.when(writes, or_empty(old)).otherwise(nothing)
        return removed, F.when(writes, or_empty(new)).otherwise(nothing)

    (gone, added), (old, new) = both(genres, old_genres), both(moods, old_moods)
    return F.struct(
        gone.alias("remove_genres"), added.alias("add_genres"), old.alias("remove_moods"), new.alias("add_moods"),
        writes_list(moods, old_moods, overwrite).alias("lock_moods"), F.when(writes_number(bpm, old_bpm, overwrite), bpm).alias("bpm"),
    )


def single_mood(mood: Column, old_moods: Column) -> Column:
    """The edits that put one mood in place of all there are."""
    none, no_bpm = F.lit(None).cast(_NONE), F.lit(None).cast("int")
    return catalog_edits(none, none, old_moods, F.array_compact(F.array(mood)), no_bpm, no_bpm, F.lit(True))


def file_accepts(path: Column, exists: Column, enabled: bool = True, dry_run: bool = False) -> Column:
    """Whether writing to a file counts as done: never when disabled or the file is missing,
    always in a dry run, else if its kind is known."""
    if not enabled:
        return F.lit(False)
    there = (F.coalesce(path, F.lit("")) != "") & F.coalesce(exists, F.lit(False))
    return there if dry_run else there & extension(F.coalesce(path, F.lit(""))).isin(*FRAMES)


def push(edits: DataFrame, key: str, call: Callable[[dict], object], dry_run: bool = False, lanes: int = 1) -> DataFrame:
    """(key, done): hands each row to ``call`` in ``lanes`` tasks; a failing call is not done.
    In a dry run nothing is called and everything is done."""
    name = edits.schema[key].dataType.simpleString()
    if dry_run:
        return edits.select(key, F.lit(True).alias("done"))

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            done = []
            for row in pdf.to_dict("records"):
                try:
                    done.append(call(row) is not False)
                except Exception:  # noqa: BLE001 - a failed edit is reported
                    done.append(False)
            yield pdf[[key]].assign(done=done)

    return edits.repartition(lanes).mapInPandas(run, f"`{key}` {name}, done boolean")
