"""One form for text that looks the same but is stored with other characters.

A batch of Arrow strings becomes one numpy array of code points. Lookup tables
then drop what is invisible, turn every kind of blank into a space, expand
width variants, ligatures and accented letters into their parts and replace
look-alike letters; blanks at the ends go; marks are put into canonical order
and composed, all on the whole batch at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantera.session import written

#: Letters of other scripts that are drawn like a Latin letter. Each Latin letter
#: is met at most once per script and case, so text wholly in one script stays distinct.
#: Cyrillic, Greek and Armenian only; look-alikes of other scripts stay apart.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y",
    "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Օ": "O", "Տ": "S", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
    # Latin letters and signs that are drawn like another
    "ɑ": "a", "ɡ": "g", "ı": "i", "ǀ": "l", "‐": "-", "‑": "-", "−": "-",
}

#: Compatibility forms that are drawn differently and therefore stay.
_VISIBLE = {"<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>", "<small>"}
_LIMIT = 0x110000
_L, _V, _T, _S = 0x1100, 0x1161, 0x11A7, 0xAC00


def _stays(cp: int) -> bool:
    """Symbol variants of Greek letters, the long s and Hangul parts look different."""
    return cp in (0x17F, 0x1E9B) or 0x3D0 <= cp <= 0x3D6 or 0x3F0 <= cp <= 0x3F5 or 0x3130 <= cp <= 0x318F


def _parts(cp: int, lookalikes: bool) -> list[int]:
    kind = unicodedata.decomposition(chr(cp)).split()
    if kind and not _stays(cp):
        tag = kind[0] if kind[0][0] == "<" else ""
        inner = [int(x, 16) for x in kind[bool(tag) :]]
        if not (tag in _VISIBLE or tag and inner[0] == 0x20):
            if not tag or lookalikes:
                return [y for x in inner for y in _parts(x, lookalikes)]
    if lookalikes and chr(cp) in LOOKALIKES:
        return [ord(LOOKALIKES[chr(cp)])]
    return [cp]


@cache
def tables(lookalikes: bool = True) -> dict[str, np.ndarray]:
    """Per code point: where its expansion starts and how long it is, its combining
    class; and the sorted pairs that compose. Built once per worker, from the
    Unicode data of Python."""
    start = np.zeros(_LIMIT, np.int32)
    size = np.ones(_LIMIT, np.int8)
    ccc = np.zeros(_LIMIT, np.uint8)
    flat: list[int] = []
    plain = np.ones(_LIMIT, bool)
    pairs: list[tuple[int, int, int]] = []
    for cp in (*range(0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        ch = chr(cp)
        ccc[cp] = unicodedata.combining(ch)
        if 0xD800 <= cp < 0xE000 or _S <= cp < _S + 11172:
            continue
        category = unicodedata.category(ch)
        if lookalikes and (category == "Zs" or cp in (9, 10, 11, 12, 13, 0x85, 0x2028, 0x2029)):
            out = [0x20]
        elif lookalikes and (category in ("Cf", "Cc") or 0xFE00 <= cp < 0xFE10 or 0xE0100 <= cp < 0xE01F0 or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5)):
            out = []
        else:
            out = _parts(cp, lookalikes)
        if out != [cp]:
            plain[cp] = False
            start[cp], size[cp] = len(flat), len(out)
            flat += out
        two = unicodedata.decomposition(ch).split()
        if len(two) == 2 and two[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            pairs.append((int(two[0], 16), int(two[1], 16), cp))
    key = np.array([a << 21 | b for a, b, _ in pairs], np.int64)
    order = np.argsort(key)
    return {
        "plain": plain, "start": start, "size": size, "flat": np.array(flat, np.uint32), "ccc": ccc,
        "pair": key[order], "whole": np.array([c for *_, c in pairs], np.uint32)[order],
    }


def _composed(a: np.ndarray, b: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """The composite of each pair, 0 where there is none."""
    key = a.astype(np.int64) << 21 | b
    at = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
    out = np.where(t["pair"][at] == key, t["whole"][at], 0).astype(np.uint32)
    x, y = a.astype(np.int64), b.astype(np.int64)
    lv = (x >= _L) & (x < _L + 19) & (y >= _V) & (y < _V + 21)
    out[lv] = (_S + ((x - _L) * 21 + y - _V) * 28)[lv]
    lvt = (x >= _S) & (x < _S + 11172) & ((x - _S) % 28 == 0) & (y > _T) & (y < _T + 28)
    out[lvt] = (x + y - _T)[lvt]
    return out


def _compose(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition; each round joins the next mark of every starter."""
    last = np.full(len(cp), -1, np.int64)  # of each starter: the place, at the beginning, of the mark it took last
    place = np.arange(len(cp))
    while len(cp) > 1:
        ccc = t["ccc"][cp]
        at = np.arange(len(cp))
        starter = np.maximum.accumulate(np.where(ccc == 0, at, -1))
        before = np.concatenate([[-1], starter[:-1]])  # nearest starter before each place
        own = np.where(ccc == 0, before, starter)
        previous = np.concatenate([[0], ccc[:-1]])
        free = (own >= 0) & ((own == at - 1) | ((previous > 0) & (previous < ccc)))
        free &= row == row[np.maximum(own, 0)]
        free &= place > last[np.maximum(own, 0)]
        can = np.flatnonzero(free)
        if not len(can):
            break
        made = _composed(cp[own[can]], cp[can], t)
        can, made = can[made > 0], made[made > 0]
        if not len(can):
            break
        first = np.unique(own[can], return_index=True)[1]
        can, made = can[first], made[first]
        # a starter that is itself joined to an earlier one waits for the next round
        waits = np.isin(own[can], can)
        can, made = can[~waits], made[~waits]
        cp = cp.copy()
        cp[own[can]] = made
        last[own[can]] = place[can]
        keep = np.ones(len(cp), bool)
        keep[can] = False
        cp, row, last, place = cp[keep], row[keep], last[keep], place[keep]
    return cp, row


def fold(texts: pa.Array, lookalikes: bool = True) -> pa.Array:
    """The one form of each text; without ``lookalikes`` it is plain canonical
    composition, which the tests hold against the standard library."""
    t = tables(lookalikes)
    n = len(texts)
    texts = texts.cast(pa.large_string())
    if not n:
        return pa.array([], pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    cuts = heads[offsets - offsets[0]]
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(n), np.diff(cuts))

    if not t["plain"][cp].all():
        plain = t["plain"][cp]
        size = np.where(plain, 1, t["size"][cp]).astype(np.int64)
        source = np.repeat(np.arange(len(cp)), size)
        step = np.arange(len(source)) - np.repeat(np.cumsum(size) - size, size)
        out = cp[source]
        moved = ~plain[source]
        out[moved] = t["flat"][t["start"][cp[source[moved]]] + step[moved]]
        cp, row = out, row[source]
    if lookalikes and len(cp):
        ink = np.cumsum(cp != 0x20)
        ends = np.searchsorted(row, np.arange(n + 1))
        total = np.concatenate([[0], ink])
        before, after = total[ends[:-1]][row], total[ends[1:]][row]
        keep = (cp != 0x20) | ((ink > before) & (ink < after))
        cp, row = cp[keep], row[keep]
    ccc = t["ccc"][cp]
    if ccc.any() or ((cp >= _L) & (cp < 0x1200)).any() or not lookalikes:
        cp, ccc = _order_rows(cp, ccc, row)
        cp, row = _compose(cp, row, t)

    lengths = np.searchsorted(row, np.arange(n + 1))
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    bytes_at = np.concatenate([[0], np.cumsum(width)])[lengths]
    blob = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    validity = texts.is_valid() if texts.null_count else None
    out = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bytes_at.astype(np.int64)), pa.py_buffer(blob))
    if validity is not None:
        out = pc.if_else(validity, out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


def _order_rows(cp: np.ndarray, ccc: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order marks without crossing a row: a mark that begins a row begins a run."""
    begins = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.empty(0, bool)
    if not len(cp):
        return cp, ccc
    run = np.cumsum((ccc == 0) | begins)
    if not ((np.diff(ccc.astype(np.int16)) < 0) & (ccc[1:] > 0) & ~begins[1:]).any():
        return cp, ccc
    order = np.lexsort((np.arange(len(cp)), ccc, run))
    return cp[order], ccc[order]


def fold_values(values: DataFrame, column: str, into: str) -> DataFrame:
    """``values`` with the text column ``column`` folded into the column ``into``;
    all columns are carried, so callers hand over distinct values only. Null stays null."""
    schema = values.select("*", F.col(column).cast("string").alias(into)).schema
    at = values.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = fold(batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, folded], names=[*batch.schema.names, into])

    return values.mapInArrow(run, schema)


def look_alike_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(field, row_a, row_b): rows whose text looks like that of an earlier row.

    For each column apart, ``row_a`` is the smallest key among all rows whose
    value looks the same and ``row_b`` any other of these rows whose stored
    value differs from ``row_a``'s. Null values take no part; the empty string
    and a blank or invisible-only string look the same. Only distinct values
    reach Python, and only values that have a look-alike are joined back, so a
    value that a third of the rows hold costs one row until that join.
    """
    long = df.select(
        F.col(key).cast("bigint").alias("row_id"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"),
    ).select("row_id", "x.field", "x.value").where(F.col("value").isNotNull())
    values = long.groupBy("field", "value").agg(F.min("row_id").alias("first_row"))
    folded = written(fold_values(values, "value", "form"), "forms")  # folded once for the groups and for the join
    groups = folded.groupBy("field", "form").agg(
        F.min(F.struct("first_row", "value")).alias("lead"), F.count(F.lit(1)).alias("n_spellings")
    )
    variants = (
        folded.join(groups.where("n_spellings > 1"), ["field", "form"])
        .where(F.col("value") != F.col("lead.value"))
        .select("field", "value", F.col("lead.first_row").alias("row_a"))
    )
    return long.join(variants, ["field", "value"]).select("field", "row_a", F.col("row_id").alias("row_b"))


def spelling_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, form, n_rows): every distinct value and the form it comes out in."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    ).select("x.field", "x.value").where(F.col("value").isNotNull())
    return fold_values(long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows")), "value", "form").select(
        "field", "value", "form", "n_rows"
    )
