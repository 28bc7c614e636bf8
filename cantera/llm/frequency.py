"""Frequency of every distinct term of an array column.

Each record first reduces its own list to (term, occurrences in the record):
the list is sorted and its runs are measured, linear after the sort even for
very long lists. The aggregation by term then adds up map-side before its one
shuffle, so a term that a third of all records hold costs one row per map task.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share_of(n: Column, total: Column, share: float | Fraction) -> tuple[Column, Column]:
    """(n * q, total * p) for the share p / q: to be compared without rounding, in decimals
    that hold counts up to 10^18."""
    exact = Fraction(share).limit_denominator(10**9)
    wide = "decimal(19,0)"
    return n.cast(wide) * F.lit(exact.denominator).cast(wide), total.cast(wide) * F.lit(exact.numerator).cast(wide)


def run_lengths(terms: Column) -> Column:
    """ARRAY<STRUCT<term, n>> of an array's distinct non-null terms with their counts."""
    ordered = F.array_sort(F.array_compact(terms))

    def bound(value: Column, use) -> Column:
        """``use`` applied to a value that is evaluated once, not at each mention."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return bound(
            starts,
            lambda at: F.transform(
                at,
                lambda p, i: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(at, i + 1), F.size(s)) - p).cast("bigint").alias("n"),
                ),
            ),
        )

    return bound(ordered, lambda s: F.when(F.size(s) > 0, runs(s)))


def term_frequencies(df: DataFrame, terms: str) -> DataFrame:
    """(term, n_occurrences, n_records) of every distinct non-null term in ``terms``.

    Null and empty arrays and null elements count nothing, the empty string is
    a term like any other, and repeated records count each time. Other columns
    of ``df`` are not read, so their names cannot clash.
    """
    per_record = df.select(F.explode(run_lengths(df[terms].cast("array<string>"))).alias("r"))
    return per_record.groupBy(F.col("r.term").alias("term")).agg(
        F.sum("r.n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_records")
    )


def mark_frequency(
    counts: DataFrame, total: DataFrame, rare_at_most: int = 2, common_over: float | Fraction = Fraction(1, 25)
) -> DataFrame:
    """Add ``verdict``: ``rare`` up to ``rare_at_most`` records, ``common`` in more
    than the share ``common_over`` of the records in the one-row frame ``total``
    (column ``n_total``), else ``useful``. Shares are compared exactly. A term both rare
    and common is rare.
    """
    own, bound = share_of(F.col("n_records"), F.col("n_total"), common_over)
    return (
        counts.crossJoin(F.broadcast(total.select("n_total")))  # one row by construction
        .withColumn(
            "verdict",
            F.when(F.col("n_records") <= rare_at_most, F.lit("rare"))
            .when(own > bound, F.lit("common"))
            .otherwise(F.lit("useful")),
        )
        .drop("n_total")
    )
