"""Write-if-empty merges into existing metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantera.functions.text import extension, or_empty

#: The field each kind of file keeps a value in.
FRAMES = {
    ".mp3": {"genre": ("TCON",), "mood": ("TMOO", "TXXX:MOOD"), "bpm": ("TBPM",)},
    ".flac": {"genre": ("genre",), "mood": ("mood",), "bpm": ("bpm",)},
    ".m4a": {"genre": ("\xa9gen",), "mood": ("----:com.apple.iTunes:mood",), "bpm": ("tmpo",)},
    ".mp4": {"genre": ("\xa9gen",), "mood": ("----:com.apple.iTunes:mood",), "bpm": ("tmpo",)},
}


def writes_list(new: Column, old: Column, overwrite: Column) -> Column:
    """Whether a new list is written: it must not be empty, and the old one must be unless overwriting."""
    return (F.size(or_empty(new)) > 0) & (F.coalesce(overwrite, F.lit(False)) | (F.size(or_empty(old)) == 0))


def merged_list(new: Column, old: Column, overwrite: Column) -> Column:
    return F.when(writes_list(new, old, overwrite), new).otherwise(or_empty(old))


def writes_number(new: Column, old: Column, overwrite: Column) -> Column:
    """Whether a number is written: it is known, and the old one is missing or 0 unless overwriting."""
    return new.isNotNull() & (F.coalesce(overwrite, F.lit(False)) | old.isNull() | (old == 0))


def merged_number(new: Column, old: Column, overwrite: Column) -> Column:
    return F.when(writes_number(new, old, overwrite), new).otherwise(old)


def _wanted(genres: Column, moods: Column, bpm: Column) -> dict[str, Column]:
    return {
        "genre": or_empty(genres),
        "mood": or_empty(moods),
        "bpm": F.when(bpm.isNotNull(), F.array(bpm.cast("string"))).otherwise(F.array().cast("array<string>")),
    }


def merged_fields(existing: Column, genres: Column, moods: Column, bpm: Column, overwrite: Column) -> dict[str, Column]:
    """What genre, mood and bpm of a file come to, by field."""
    old = {f: F.try_element_at(existing, F.lit(f)) for f in ("genre", "mood", "bpm")}
    return {f: merged_list(new, old[f], overwrite) for f, new in _wanted(genres, moods, bpm).items()}


def file_modified(path: Column, existing: Column, genres: Column, moods: Column, bpm: Column, overwrite: Column) -> Column:
    """Whether writing to a file would change it; never for a missing path or an unknown kind of file."""
    old = {f: F.try_element_at(existing, F.lit(f)) for f in ("genre", "mood", "bpm")}
    changed = F.lit(False)
    for field, new in _wanted(genres, moods, bpm).items():
        changed = changed | writes_list(new, old[field], overwrite)
    return (F.coalesce(path, F.lit("")) != "") & extension(F.coalesce(path, F.lit(""))).isin(*FRAMES) & changed


def _first_frame(kind: str):
    named = F.create_map(*[F.lit(x) for field, names in FRAMES[kind].items() for x in (field, names[0])])
    return lambda k, v: F.element_at(named, k)


def held_frames(path: Column, existing: Column) -> Column:
    """A file's fields (genre, mood, bpm) under the frames that files of its kind keep them in."""
    ext = extension(F.coalesce(path, F.lit("")))
    kinds = {".mp3": ext == ".mp3", ".flac": ext == ".flac", ".m4a": ext.isin(".m4a", ".mp4")}
    out = F.create_map().cast("map<string,array<string>>")
    for kind, fits in kinds.items():
        fields = F.map_filter(existing, lambda k, v: k.isin(*FRAMES[kind]))
        out = F.when(fits & existing.isNotNull(), F.transform_keys(fields, _first_frame(kind))).otherwise(out)
    return out


def frame_writes(path: Column, frames: Column, genres: Column, moods: Column, bpm: Column, overwrite: Column) -> Column:
    """ARRAY<STRUCT<frame, values>> to be written to a file, each frame by itself.

    ``frames`` maps a file's frames to what they hold now.
    """
    wanted = _wanted(genres, moods, bpm)

    def of(kind: str) -> Column:
        cells = [
            F.when(
                writes_list(wanted[field], F.try_element_at(frames, F.lit(frame)), overwrite),
                F.struct(F.lit(frame).alias("frame"), wanted[field].alias("values")),
            )
            for field, names in FRAMES[kind].items()
            for frame in names
        ]
        return F.array_compact(F.array(*cells))

    ext = extension(F.coalesce(path, F.lit("")))
    out = F.when(ext == ".mp3", of(".mp3")).when(ext == ".flac", of(".flac")).when(ext.isin(".m4a", ".mp4"), of(".m4a"))
    return out.otherwise(F.array().cast("array<struct<frame:string,values:array<string>>>"))


def mood_command(path: Column, moods: Column, binary: str = "beet") -> Column:
    """Arguments of the tagger's command for the first mood; null without path or mood."""
    mood = F.try_element_at(moods, F.lit(1))
    words = [F.lit(binary), F.lit("modify"), F.lit("-y"), F.concat(F.lit("path:"), path), F.concat(F.lit("mood="), mood)]
    return F.when((path != "") & mood.isNotNull(), F.array(*words))
