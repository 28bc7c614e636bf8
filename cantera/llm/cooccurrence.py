"""Items that occur together: stripes with map-side merging, lift and log-likelihood.

Each task keeps, for every item, the counts of its neighbours over many records
and sends one stripe per item and flush instead of one row per pair. Stripes are
cut by neighbour hash, so the stripes of an item that a third of all records hold
are merged by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.llm.frequency import share_of

STRIPE = "item_a string, slice int, neighbours array<struct<item:string,n:bigint>>"


def item_counts(df: DataFrame, items: str) -> DataFrame:
    """(item, n): the number of records that hold each item at least once."""
    return df.select(F.explode(F.array_distinct(F.array_compact(items))).alias("item")).groupBy("item").agg(
        F.count(F.lit(1)).alias("n")
    )


def _record_pairs(codes: np.ndarray, rows: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (smaller code, larger code) within each row, at most about ``limit`` at a time.

    ``codes`` is sorted within rows and has no repeats. Position i is paired with
    i + 1, i + 2, ... for as long as the row lasts.
    """
    ends = np.searchsorted(rows, rows, "right")
    left = ends - np.arange(len(rows)) - 1
    at = 0
    bounds = np.concatenate([[0], np.cumsum(left)])
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        n = left[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        if len(i):
            yield codes[i], codes[j]
        at = to


def _stripes(keep: pa.Array | None, slices: int, flush_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: pa.Array = pa.array([], pa.string()) if keep is None else keep
        pairs = np.empty(0, np.uint64)
        counts = np.empty(0, np.int64)

        def merge(new: list[np.ndarray], weight: list[np.ndarray]) -> None:
            nonlocal pairs, counts
            every, w = np.concatenate([pairs, *new]), np.concatenate([counts, *weight])
            pairs, inverse = np.unique(every, return_inverse=True)
            counts = np.bincount(inverse, w, len(pairs)).astype(np.int64)

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal pairs, counts
            if not len(pairs):
                return
            a = (pairs >> np.uint64(32)).astype(np.int64)
            b = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            part = (b * 2654435761 % (1 << 32)) * slices >> 32
            order = np.lexsort((b, part, a))
            a, b, part, n = a[order], b[order], part[order], counts[order]
            cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])]))
            offsets = pa.array(np.concatenate([cut, [len(a)]]), pa.int32())
            inner = pa.StructArray.from_arrays([names.take(pa.array(b)), pa.array(n)], ["item", "n"])
            full = pa.RecordBatch.from_arrays(
                [names.take(pa.array(a[cut])), pa.array(part[cut], pa.int32()), pa.ListArray.from_arrays(offsets, inner)],
                names=["item_a", "slice", "neighbours"],
            )
            for k in range(0, full.num_rows, 5000):
                yield full.slice(k, 5000)
            pairs, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        for batch in batches:
            lists = batch.column(0)
            flat = pc.list_flatten(lists).cast(pa.string())
            rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            if keep is None:
                # codes of this flush only: they follow the order of the strings
                distinct = pc.unique(pa.concat_arrays([names, flat.drop_null()]))
                distinct = distinct.take(pc.sort_indices(distinct))
                if len(distinct) != len(names):
                    old = pc.index_in(names, value_set=distinct).to_numpy(zero_copy_only=False).astype(np.uint64)
                    if len(pairs):
                        pairs = old[(pairs >> np.uint64(32)).astype(np.int64)] << np.uint64(32) | old[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
                    names = distinct
            codes = pc.index_in(flat, value_set=names)
            known = codes.is_valid().to_numpy(zero_copy_only=False)
            codes = pc.fill_null(codes, 0).to_numpy(zero_copy_only=False).astype(np.uint64)[known]
            both = np.unique(rows[known].astype(np.uint64) << np.uint64(32) | codes)
            rows, codes = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)
            for i, j in _record_pairs(codes, rows, 4_000_000):
                new, weight = np.unique(i << np.uint64(32) | j, return_counts=True)
                merge([new], [weight])
                if len(pairs) > flush_pairs:
                    yield from emit()
            if keep is None and not len(pairs):
                names = pa.array([], pa.string())
        yield from emit()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes sorted by (item, slice) → one stripe for each of them, counts of equal neighbours added."""

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, part, lists = batch.columns
        n = len(a)
        new = np.ones(n, bool)
        new[1:] = pc.or_(pc.not_equal(a.slice(1), a.slice(0, n - 1)), pc.not_equal(part.slice(1), part.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        run = (np.cumsum(new) - 1)[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)]
        inner = pc.list_flatten(lists)
        items = inner.field(0).dictionary_encode()
        codes = items.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        both, inverse = np.unique(run.astype(np.int64) << 32 | codes, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        cuts = np.searchsorted(inverse[order], np.arange(len(both)))
        sums = np.add.reduceat(inner.field(1).to_numpy(zero_copy_only=False)[order], cuts) if len(both) else np.empty(0, np.int64)
        offsets = np.searchsorted(both >> 32, np.arange(len(first) + 1))
        out = pa.StructArray.from_arrays([items.dictionary.take(pa.array(both & 0xFFFFFFFF)), pa.array(sums, pa.int64())], ["item", "n"])
        index = pa.array(first)
        columns = [a.take(index), part.take(index), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), out)]
        return pa.RecordBatch.from_arrays(columns, names=["item_a", "slice", "neighbours"])

    held: pa.RecordBatch | None = None  # the last stripe, which the next batch may go on with
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, names=["item_a", "slice", "neighbours"])
        if held is not None:
            batch = pa.concat_batches([held, batch.cast(held.schema)])
        merged = merge(batch)
        yield merged.slice(0, merged.num_rows - 1)
        held = merged.slice(merged.num_rows - 1)
    if held is not None:
        yield held


def pair_counts(
    df: DataFrame,
    items: str,
    keep: pa.Array | None = None,
    slices: int = 16,
    flush_pairs: int = 1_000_000,
) -> DataFrame:
    """(item_a, item_b, n_ab) of all pairs that occur together, item_a < item_b by code point.

    ``keep``, sorted, restricts the items counted. Stripes meet by (item, slice of
    the neighbours) and are merged array by array; a merged stripe holds the distinct
    neighbours of one item in one slice, and only then are its pairs written out.
    """
    if keep is not None:
        shared = df.sparkSession.sparkContext.broadcast(keep)
        run = lambda batches: _stripes(shared.value, slices, flush_pairs)(batches)
    else:
        run = _stripes(None, slices, flush_pairs)
    stripes = df.select(F.col(items)).mapInArrow(run, STRIPE)
    merged = stripes.repartition("item_a", "slice").sortWithinPartitions("item_a", "slice").mapInArrow(_merged, STRIPE)
    return merged.select("item_a", F.inline("neighbours")).select("item_a", F.col("item").alias("item_b"), F.col("n").alias("n_ab"))


def log_likelihood(n_ab: Column, n_a: Column, n_b: Column, total: Column) -> Column:
    """Dunning's G² of the 2×2 table of two items."""
    a, b, n = (x.cast("double") for x in (n_a, n_b, total))  # products of counts overflow BIGINT from 3e9 records on
    cells = [(n_ab, a * b), (n_a - n_ab, a * (n - b)), (n_b - n_ab, (n - a) * b), (total - n_a - n_b + n_ab, (n - a) * (n - b))]
    terms = [F.when(k > 0, k.cast("double") * F.log(k.cast("double") * n / e)).otherwise(F.lit(0.0)) for k, e in cells]
    return F.lit(2.0) * (terms[0] + terms[1] + terms[2] + terms[3])


def cooccurrence(
    df: DataFrame,
    items: str,
    min_support: float | Fraction = 0,
    min_lift: float | Fraction = 0,
    min_llr: float | None = None,
    max_broadcast_items: int = 200_000,
) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_total, lift, llr) of items in the array column ``items``.

    Every row of ``df`` counts as a record, also with a null or empty array; null
    elements are no items, repeats in one record count once. Kept are pairs with
    n_ab >= min_support * n_total and lift >= min_lift, both compared exactly, and, if it is
    given, llr >= min_llr: how sure it is that they do not meet by chance (10.83 is one
    in a thousand), whatever their number. An item rarer than the
    support is in no such pair, so such items are left out before pairing: at most
    (mean items a record) / min_support items remain. They are counted before they
    are broadcast; beyond ``max_broadcast_items``, or without support, all items are paired.
    """
    total = df.agg(F.count(F.lit(1)).alias("n_total"))
    counts = item_counts(df, items)
    keep = None
    if min_support > 0:
        own, bound = share_of(F.col("n"), F.col("n_total"), min_support)
        enough = counts.crossJoin(F.broadcast(total)).where(own >= bound)  # one row
        names = [tuple(r) for r in enough.select("item", "n").limit(max_broadcast_items + 1).collect()]
        if len(names) <= max_broadcast_items:
            keep = pa.array(sorted(r[0] for r in names), pa.string())
    pairs = pair_counts(df, items, keep).crossJoin(F.broadcast(total))
    if min_support > 0:
        own, bound = share_of(F.col("n_ab"), F.col("n_total"), min_support)
        pairs = pairs.where(own >= bound)
    if keep is not None:  # the counts are known by now: one row for each item kept
        counts = df.sparkSession.createDataFrame(sorted(names), "item string, n bigint")
    a = counts.select(F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    b = counts.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    if keep is not None:
        a, b = F.broadcast(a), F.broadcast(b)
    n_ab, n_a, n_b, n = F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n_total")
    lift = Fraction(min_lift).limit_denominator(10**6)
    wide = {x: F.col(x).cast("decimal(15,0)") for x in ("n_ab", "n_a", "n_b", "n_total")}
    together = wide["n_ab"] * wide["n_total"] * F.lit(lift.denominator).cast("decimal(7,0)")
    by_chance = wide["n_a"] * wide["n_b"] * F.lit(lift.numerator).cast("decimal(7,0)")
    found = (
        pairs.join(a, "item_a")
        .join(b, "item_b")
        .where(together >= by_chance)
        .select(
            "item_a", "item_b", "n_ab", "n_a", "n_b", "n_total",
            (n_ab.cast("double") * n / (n_a.cast("double") * n_b)).alias("lift"),
            log_likelihood(n_ab, n_a, n_b, n).alias("llr"),
        )
    )
    return found if min_llr is None else found.where(F.col("llr") >= min_llr)
