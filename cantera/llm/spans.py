"""Long stretches that occur verbatim in other documents, by compact windows.

Tokens are overlapping q-grams of characters, q = half the least length, each with
a mixed 64-bit hash. A document's Cartesian tree over these hashes groups its
subsequences of t = min_length - q + 1 tokens by their minimum: the compact window
(left, centre, right) stands for every such subsequence inside [left, right] whose
minimum lies at ``centre``, and there are about 2n / t of them. A shared stretch
holds the same subsequence in both documents, so under every hash function both have
a compact window with the same minimum around it.

Windows are intervals of places at which a stretch may start. Signatures of one
document only are dropped first. The windows that are left get the text of their
interval, meet by signature where their intervals overlap, and are verified by comparing that
text around the common minimum: what is equal is one row, however many stretches it holds.

For verbatim stretches one hash function finds everything. More are used where more than
``cap`` windows share a signature (near-standing footers, formulas): each
further hash, over longer tokens, cuts a window's interval by its own minima and joins
the signature, so that windows only stay together if they share more of a stretch. What is
still crowded after the last hash is grouped by the stretches themselves, and a
class of equal stretches is left as a class: no pairs are made of it here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantera.session import written

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Characters handled at once: bounds the memory of a task for texts of any length.
CHUNK = 1 << 18
#: Lower bits of a hash that give way to its place while minima are looked for.
PLACE_BITS = 24
#: Bits of the filter on document ids: at most 8 MB are broadcast, however many documents there are.
FILTER_BITS = 1 << 26
CONTEXT = "signature bigint, doc_id bigint, centre int, first int, context string"


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a batch in one array, and where each text starts in it."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), heads[offsets - offsets[0]]


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(out, out=out)
    return out


def rolling_hash(cp: np.ndarray, q: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of q code points, the same wherever the run stands."""
    m = len(cp) - q + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    base = (_BASE + 2 * seed) & _MASK
    size = 1 << (len(cp) - 1).bit_length()  # few sizes, so that few tables of powers are made
    up, down = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
    with np.errstate(over="ignore"):
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(_mix(cp.astype(np.uint64) + np.uint64(seed + 1)) * up[: len(cp)], out=total[1:])
        return _mix((total[q:] - total[:m]) * down[:m])


def compact_windows(h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of every compact window of at least t tokens.

    A window is the subtree of its centre in the Cartesian tree over the hashes, cut to t - 1
    tokens on either side, which loses no subsequence of t tokens: it is the run of
    subsequences whose minimum the centre is. The minima of all subsequences come from
    running minima of blocks of t tokens, forwards and backwards. Hashes are compared
    by their upper 40 bits, of equal ones the first is the minimum. A hash of 0 marks a
    token that no window may hold. Fewer than 2^24 tokens are taken at once.
    """
    n = len(h)
    m = n - t + 1
    if m <= 0:
        return (np.empty(0, np.int64),) * 3
    low = np.uint64((1 << PLACE_BITS) - 1)
    packed = np.full(-(-n // t) * t, np.iinfo(np.uint64).max)
    packed[:n] = np.where(h > 0, np.maximum(h, low + np.uint64(1)), np.uint64(0)) & ~low | np.arange(n, dtype=np.uint64)
    blocks = packed.reshape(-1, t)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:m], ahead[t - 1 : t - 1 + m]) & low
    edge = np.flatnonzero(np.diff(least)) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge, [m]]) - 1
    centre = least[first].astype(np.int64)
    ok = h[centre] > 0
    return first[ok], centre[ok], last[ok] + t - 1


def _pieces(starts: np.ndarray, least: int, chunk: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Cuts a batch into pieces of about ``chunk`` characters: (first text, end text,
    from, to, end of the places at which this piece's stretches start).

    Short texts go together; a longer one is cut so that each stretch of ``least``
    characters lies wholly in the piece that holds its start.
    """
    n, a = len(starts) - 1, 0
    while a < n:
        size = starts[a + 1] - starts[a]
        if size > chunk:
            for at in range(int(starts[a]), int(starts[a + 1]) - least + 1, chunk):
                end = int(starts[a + 1])
                yield a, a + 1, at, min(end, at + chunk + least - 1), min(end, at + chunk)
            a += 1
            continue
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + chunk, "right")) - 1)
        yield a, b, int(starts[a]), int(starts[b]), int(starts[b])
        a = b


def _windows(length: int, q: int, chunk: int):
    t = length - q + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cp, starts = code_points(batch.column(1))
            for a, b, lo, hi, _ in _pieces(starts, length, chunk):
                h = np.maximum(rolling_hash(cp[lo:hi], q), np.uint64(1))
                for edge in starts[a + 1 : b] - lo:  # tokens over a border between texts
                    h[max(0, edge - q + 1) : edge] = 0
                left, centre, right = compact_windows(h, t)
                first, last = np.maximum(left, centre - t + 1), np.minimum(centre, right - t + 1)
                text = np.searchsorted(starts, centre + lo, "right") - 1
                base = starts[text] - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[centre].view(np.int64)), batch.column(0).take(pa.array(text)),
                        *(pa.array((x - base).astype(np.int32)) for x in (centre, first, last)),
                    ],
                    names=["signature", "doc_id", "centre", "first", "last"],
                )

    return run


def _contexts(length: int):
    """Windows of a document → one row each with the text of its stretches and one
    character before them. Where rows share an id, a window may get another row's
    text; whatever is found equal in it is shared all the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            owner = pc.list_parent_indices(lists)
            inner = pc.list_flatten(lists)
            sign, centre, first, last = (inner.field(k) for k in range(4))
            texts = batch.column(1).to_pylist()
            places = zip(owner.to_pylist(), first.to_pylist(), last.to_pylist())
            context = pa.array([texts[i][max(a - 1, 0) : b + length] for i, a, b in places], pa.string())
            yield pa.RecordBatch.from_arrays(
                [sign, batch.column(0).take(owner), centre, first, context], names=["signature", "doc_id", "centre", "first", "context"]
            )

    return run


class _Rows:
    """Context rows of a batch as code points: where each row's text lies in them and
    which place of its document it begins at."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.cp, self.starts = code_points(batch.column(4))
        self.centre, self.first = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
        self.begin = np.maximum(self.first - 1, 0)
        self.doc = batch.column(1).to_numpy(zero_copy_only=False)
        self.key = batch.column(0).to_numpy(zero_copy_only=False)


def _group_pairs(key: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of equal neighbouring keys, about ``limit`` at a time."""
    left = np.searchsorted(key, key, "right") - np.arange(len(key)) - 1
    bounds = np.concatenate([[0], np.cumsum(left)])
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        n = left[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _equal_around(r: _Rows, i: np.ndarray, j: np.ndarray, t: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many characters before and from the centre on are equal in two rows each."""
    reach = np.arange(1 - t, length)

    def chars(x: np.ndarray, missing: int) -> np.ndarray:
        at = (r.starts[x] + r.centre[x] - r.begin[x])[:, None] + reach
        inside = (at >= r.starts[x][:, None]) & (at < r.starts[x + 1][:, None])
        return np.where(inside, r.cp[np.clip(at, 0, len(r.cp) - 1)], missing)

    same = chars(i, 0xFFFFFFFF) == chars(j, 0xFFFFFFFE)
    wall = np.zeros((len(i), 1), bool)
    before = np.argmin(np.concatenate([same[:, : t - 1][:, ::-1], wall], axis=1), axis=1)
    after = np.argmin(np.concatenate([same[:, t - 1 :], wall], axis=1), axis=1)
    return before, after


def _matches(length: int, q: int):
    """Context rows sorted by signature → (doc_a, start_a, doc_b, start_b, n_chars) of
    every two windows that hold at least ``length`` equal characters around their centre."""
    t = length - q + 1

    def match(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        r = _Rows(batch)
        size = np.diff(r.starts)
        last = r.begin + size - length  # the last place a stretch of the row starts at
        for i, j in _group_pairs(r.key, 4096):
            low = np.maximum((r.first - r.centre)[i], (r.first - r.centre)[j])
            high = np.minimum((last - r.centre)[i], (last - r.centre)[j])
            ok = (low <= high) & (r.doc[i] != r.doc[j])
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            swap = r.doc[i] > r.doc[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            before, after = _equal_around(r, i, j, t, length)
            ok = before + after >= length
            i, j, before, n = i[ok], j[ok], before[ok], (before + after)[ok]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(r.doc[i]), pa.array((r.centre[i] - before).astype(np.int32)),
                    pa.array(r.doc[j]), pa.array((r.centre[j] - before).astype(np.int32)), pa.array(n.astype(np.int32)),
                ],
                names=["doc_a", "start_a", "doc_b", "start_b", "n_chars"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last signature's rows, at most the cap
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = batch.column(0).to_numpy(zero_copy_only=False)
            edge = int(np.searchsorted(key, key[-1], "left"))
            yield from match(batch.slice(0, edge))
            held = batch.slice(edge)
        if held is not None:
            yield from match(held)

    return run


def _cells(length: int, q: int, seed: int):
    """Windows cut by the minima of another hash over tokens of q characters; the
    minimum and its distance from the first centre join the signature."""
    t = length - q + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = _Rows(batch)
            h = np.maximum(rolling_hash(r.cp, q, seed), np.uint64(1))
            for k in range(1, q):  # tokens over a border between rows
                at = r.starts[1:-1] - k
                h[at[(at >= 0) & (at < len(h))]] = 0
            left, centre, right = compact_windows(h, t)
            row = np.searchsorted(r.starts, centre, "right") - 1
            shift = r.begin[row] - r.starts[row]  # from places of the batch to places of the document
            first = np.maximum(np.maximum(left, centre - t + 1) + shift, r.first[row])
            last = np.minimum(centre, right - t + 1) + shift
            ok = first <= last
            row, first, last, shift, centre = row[ok], first[ok], last[ok], shift[ok], centre[ok]
            with np.errstate(over="ignore"):
                away = (centre + shift - r.centre[row]).astype(np.uint64)
                key = _mix(r.key[row].view(np.uint64) * np.uint64(3) + _mix(h[centre] + _mix(away + np.uint64(7))))
            texts = batch.column(4).to_pylist()
            base = r.begin[row]
            context = [texts[x][max(a - 1 - o, 0) : b - o + length] for x, a, b, o in zip(row.tolist(), first.tolist(), last.tolist(), base.tolist())]
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)), batch.column(1).take(index), batch.column(2).take(index),
                    pa.array(first.astype(np.int32)), pa.array(context, pa.string()),
                ],
                names=["signature", "doc_id", "centre", "first", "context"],
            )

    return run


def _exact(length: int):
    """Context rows → each stretch with two hashes and the character before it, null at
    the beginning of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = _Rows(batch)
            lead = r.first - r.begin
            n = np.maximum(np.diff(r.starts) - lead - length + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = r.starts[row] + lead[row] + step
            if not len(at):
                continue
            one, two = (rolling_hash(r.cp, length, seed).view(np.int64) for seed in (0, 1))
            start = r.first[row] + step
            before = pa.array(r.cp[np.maximum(at - 1, 0)].astype(np.int32), mask=start == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one[at]), pa.array(two[at]), before, batch.column(1).take(pa.array(row)), pa.array(start.astype(np.int32))],
                names=["key1", "key2", "before", "doc_id", "start"],
            )

    return run


def _of_listed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``doc_id`` is not in ``ids``, by a bit for each
    id modulo ``FILTER_BITS``: the texts of most other documents need not be shuffled."""
    bucket, place = f"shiftright(pmod(doc_id, {FILTER_BITS}), 15)", "pmod(doc_id, 32768)"
    bits = ids.selectExpr(f"{bucket} AS bucket", f"{place} AS place").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    byte = f"cast(conv(hex(substring(bits, cast({place} div 8 as int) + 1, 1)), 16, 10) as int)"
    met = rows.withColumn("bucket", F.expr(bucket)).join(F.broadcast(bits), "bucket")  # FILTER_BITS / 32768 rows of 4 KB at most
    return met.where(f"shiftright({byte}, cast(pmod(doc_id, 8) as int)) & 1 = 1").drop("bucket", "bits")


def _shared(keyed: DataFrame, cap: int) -> DataFrame:
    """Rows whose signature several documents hold; ``crowded`` if more than ``cap`` rows do."""
    sizes = (
        keyed.groupBy("signature")
        .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n"))
        .where("a <> b")
        .select("signature", (F.col("n") > cap).alias("crowded"))
    )
    return keyed.join(sizes, "signature")


def shared_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 240, hashes: int = 3, cap: int = 64, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame | None]:
    """(passages, classes) of stretches of ``min_length`` or more code points.

    passages (doc_a, start_a, doc_b, start_b, n_chars), doc_a < doc_b: equal text around a
    window that two documents share, one row for each common window however many stretches
    it holds. classes (key1, key2, before, doc_id, start): the members of each stretch
    whose windows are more than ``cap`` under all ``hashes`` hash functions; equal keys are
    one class, ``before`` is the character before the stretch. None if there are no such.

    Null ids and texts and shorter texts have no stretches; rows with one id are parts of one
    document; equal rows count once. Other columns are not read. ``start`` counts from 0.
    """
    q = min_length // 2
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.where((F.length("text") >= min_length) & F.col("doc_id").isNotNull())
    windows = written(
        rows.mapInArrow(_windows(min_length, q, chunk), "signature bigint, doc_id bigint, centre int, first int, last int"), "windows"
    )
    kept = written(_shared(windows, cap), "kept")

    def contexts(part: DataFrame) -> DataFrame:
        window = F.struct("signature", "centre", "first", "last")
        by_doc = part.groupBy("doc_id").agg(F.collect_set(window).alias("windows"))  # at most the document's own
        met = _of_listed(rows, part.select("doc_id")).join(by_doc, "doc_id")
        return met.select("doc_id", "text", "windows").mapInArrow(_contexts(min_length), CONTEXT)

    def matched(part: DataFrame) -> DataFrame:
        together = part.repartition("signature").sortWithinPartitions("signature")  # at most cap rows a signature
        return together.mapInArrow(_matches(min_length, q), "doc_a bigint, start_a int, doc_b bigint, start_b int, n_chars int")

    found = matched(contexts(kept.where("not crowded")))
    if kept.where("crowded").isEmpty():
        return found, None
    rest = contexts(kept.where("crowded"))
    for level in range(1, hashes):
        longer = min_length - max((min_length - q) >> level, 1)
        cells = _shared(written(rest.mapInArrow(_cells(min_length, longer, level), CONTEXT), "cells"), cap)
        found = found.unionByName(matched(cells.where("not crowded").drop("crowded")))
        rest = cells.where("crowded").drop("crowded")
    return found, rest.mapInArrow(_exact(min_length), "key1 bigint, key2 bigint, before int, doc_id bigint, start int")


def shared_pairs(passages: DataFrame, classes: DataFrame | None) -> DataFrame:
    """(doc_a, doc_b): each pair of documents that share a stretch, smaller id first.

    This alone writes out the pairs of a class, and only at a stretch before which the two
    texts differ, or one begins: every shared passage has one such stretch.
    """
    pairs = passages.select("doc_a", "doc_b")
    if classes is None:
        return pairs.distinct()
    members = classes.distinct()
    forks = (
        members.groupBy("key1", "key2")
        .agg(
            F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("before").alias("p"), F.max("before").alias("r"),
            F.count("before").alias("n"), F.count(F.lit(1)).alias("m"),
        )
        .where("a <> b and (n < m or p <> r)")
        .select("key1", "key2")
    )
    members = members.join(forks, ["key1", "key2"], "left_semi")
    other = members.select("key1", "key2", F.col("before").alias("before_b"), F.col("doc_id").alias("doc_b"))
    met = (
        members.join(other, ["key1", "key2"])
        .where("doc_id < doc_b and (before is null or before_b is null or before <> before_b)")
        .select(F.col("doc_id").alias("doc_a"), "doc_b")
    )
    return pairs.unionByName(met).distinct()


def shared_spans(passages: DataFrame, classes: DataFrame | None, min_length: int = 240) -> DataFrame:
    """(doc_id, start, n_chars): the parts of each document that occur elsewhere,
    overlapping and touching ones joined; ``start`` counts code points from 0."""
    sides = [passages.select(F.col(f"doc_{x}").alias("doc_id"), F.col(f"start_{x}").alias("start"), "n_chars") for x in "ab"]
    parts = sides[0].unionByName(sides[1])
    if classes is not None:
        keys = classes.groupBy("key1", "key2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b")
        held = classes.join(keys, ["key1", "key2"], "left_semi")
        parts = parts.unionByName(held.select("doc_id", "start", F.lit(min_length).alias("n_chars")))
    parts = parts.groupBy("doc_id", "start").agg(F.max("n_chars").alias("n_chars"))
    by_doc = Window.partitionBy("doc_id").orderBy("start")  # at most the document's own windows
    reached = F.max(F.col("start") + F.col("n_chars")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start") > reached).cast("int"), F.lit(1))
    return (
        parts.withColumn("fresh", fresh)
        .withColumn("span", F.sum("fresh").over(by_doc))
        .groupBy("doc_id", "span")
        .agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n_chars")) - F.min("start")).cast("int").alias("n_chars"))
        .select("doc_id", "start", "n_chars")
    )


def shared_parts(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_spans, n_shared, share) of every document; null texts count 0 characters."""
    found = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum("n_chars").alias("n_shared"))
    size = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    n_shared = F.coalesce(F.col("n_shared"), F.lit(0)).cast("bigint")
    return size.join(found, "doc_id", "left").select(
        "doc_id", "n_chars", F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"), n_shared.alias("n_shared"),
        F.when(F.col("n_chars") > 0, F.round(n_shared / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("share"),
    )
