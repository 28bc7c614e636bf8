"""Addresses that look-ups ask, for services whose base address the caller gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantera.functions.text import quotes_escaped, url_encoded


def page_url(base: str, artist: Column, album: Column | None = None, title: Column | None = None) -> Column:
    """The page of tags of a track, an album or an artist; names are encoded with ``+`` for blanks."""
    parts = [F.lit(base.rstrip("/")), url_encoded(artist)]
    if title is not None:
        parts += [F.lit("_"), url_encoded(title)]
    elif album is not None:
        parts.append(url_encoded(album))
    path = parts[0]
    for part in (*parts[1:], F.lit("+tags")):
        path = F.concat(path, F.lit("/"), part)
    return path


def _quoted(text: Column) -> Column:
    """Percent-encoding that leaves ``/`` alone."""
    return F.replace(url_encoded(text, "%20"), F.lit("%2F"), F.lit("/"))


def recording_url(base: str, artist: Column, title: Column) -> Column:
    """The search for a recording, whose title may also be that of a track."""
    name, by = quotes_escaped(title), quotes_escaped(artist)
    query = F.concat(F.lit('artist:"'), by, F.lit('" AND (recording:"'), name, F.lit('" OR track:"'), name, F.lit('")'))
    return F.concat(F.lit(f"{base}?query="), _quoted(query), F.lit("&fmt=json"))


def release_url(base: str, artist: Column, title: Column, token: str | None) -> Column:
    """The search for a release; null without a token, which the service asks for."""
    if not token:
        return F.lit(None).cast("string")
    return F.concat(F.lit(f"{base}?q="), _quoted(F.concat(artist, F.lit(" - "), title)), F.lit("&type=release"))
