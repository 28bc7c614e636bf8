"""Records that differ only in formatting: range partition, sort, scan adjacent runs.

A record's key is written out in full, each part with its length before it, so
that different records never get the same key. Rows are range-partitioned and
sorted by (hash of the key, key, row id): a set of copies that a third of all
rows belong to spans as many partitions as it needs. One scan compares each full
key with the one before it. Runs that reach over a partition's edge are settled
by a table with one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.session import checkpoint, written

#: White space and punctuation of any script.
IGNORED = r"[\p{IsWhite_Space}\p{P}]+"


def canonical_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), IGNORED, "")


def _part(text: Column) -> Column:
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def record_key(exact: list[Column], terms: Column) -> Column:
    """One string for the columns as stored and the terms as a multiset, formatting disregarded."""
    bag = F.array_sort(F.transform(terms, lambda x: _part(canonical_text(x))))
    return F.concat(*[_part(c.cast("string")) for c in exact], F.lit("|"), F.array_join(bag, ""))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key → runs. Kinds: ``copy`` a further row of a run, ``run`` its end
    with its length; a partition's first run says so in ``opens``; ``edge`` gives the
    keys of the first and of the last run."""
    part = TaskContext.get().partitionId()
    key = head = None
    length, first, edge = 0, True, None

    def out(kind, row, heads, n, opens, keys=None):
        size = len(row)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * size, pa.string()), pa.array(row, pa.int64()), pa.array(heads, pa.int64()),
                pa.array(n, pa.int64()), pa.array(opens, pa.bool_()), pa.array([part] * size, pa.int32()),
                pa.array(keys if keys is not None else [None] * size, pa.string()),
            ],
            names=["kind", "row_id", "head", "n", "opens", "part", "key"],
        )

    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        rows, keys = batch.column(0).to_numpy(), batch.column(1)
        same = np.zeros(size, bool)
        if size > 1:
            same[1:] = pc.equal(keys.slice(1), keys.slice(0, size - 1)).to_numpy(zero_copy_only=False)
        same[0] = key is not None and keys[0].as_py() == key
        start = np.flatnonzero(~same)
        run_of = np.cumsum(~same)  # 0: continues the run carried over
        heads = np.concatenate([[head if head is not None else -1], rows[start]])[run_of]
        opens = (run_of == 0) & first if key is not None else run_of == 1
        if same.any():
            yield out("copy", rows[same], heads[same], np.ones(same.sum(), np.int64), opens[same])
        counts = np.bincount(run_of, minlength=len(start) + 1)
        if key is None:
            edge = keys[0].as_py(), int(rows[0])
        else:
            counts[0] += length
        if len(start):
            closed_heads = np.concatenate([[head if head is not None else -1], rows[start]])[:-1]
            closed = counts[:-1]
            opening = np.zeros(len(closed), bool)
            if key is None:
                closed_heads, closed, opening = closed_heads[1:], closed[1:], opening[1:]
                if len(opening):
                    opening[0] = True
            else:
                opening[0] = first
            if len(closed):
                yield out("run", closed_heads, closed_heads, closed, opening)
            first = key is None and len(start) == 1
            head, length = int(rows[start[-1]]), int(counts[-1])
        else:
            length = int(counts[0])
        key = keys[size - 1].as_py()
    if key is not None:
        yield out("run", [head], [head], [length], [first])
        yield out("edge", [edge[1], head], [edge[1], head], [0, 0], [True, False], [edge[0], key])


def formatting_runs(df: DataFrame, key: str, exact: list[str], terms: str) -> tuple[DataFrame, DataFrame]:
    """(copies, runs): copies (row_a, row_b) and runs (row_a, n_copies) of every record.

    Rows count as copies when the columns ``exact`` are equal as stored (null equals
    null) and ``terms`` holds the same values equally often once case, white space,
    punctuation and order are disregarded; ``row_a`` is the smallest key of the set.
    Rows with null or empty ``terms`` take no part. A null element equals only a null
    element, an element of punctuation alone equals an empty one. An empty table gives
    two empty tables. Other columns are not read.
    """
    rows = df.where(F.size(terms) > 0).select(
        F.col(key).cast("bigint").alias("row_id"),
        record_key([F.col(c) for c in exact], F.col(terms)).alias("key"),
    )
    keyed = written(rows.withColumn("hash", F.xxhash64("key")), "keys")  # the sampling of the ranges reads them as well
    order = ["hash", "key", "row_id"]
    scanned = checkpoint(
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("row_id", "key")
        .mapInArrow(_scan, "kind string, row_id bigint, head bigint, n bigint, opens boolean, part int, key string")
    )
    edges = scanned.where("kind = 'edge'")
    lead = edges.groupBy("key").agg(F.min("head").alias("lead"))
    # one row for each partition: the head of the whole run that its first run belongs to
    opening = edges.where("opens").join(lead, "key").select("part", "lead", F.lit(True).alias("opens"))

    def settled(kind: str) -> DataFrame:
        return (
            scanned.where(F.col("kind") == kind)
            .join(F.broadcast(opening), ["part", "opens"], "left")
            .withColumn("row_a", F.coalesce("lead", "head"))
        )

    # the head of a partition's first run is itself a copy when the run began before
    heads = settled("run").where("opens and row_a <> row_id").select("row_a", F.col("row_id").alias("row_b"))
    copies = settled("copy").select("row_a", F.col("row_id").alias("row_b")).unionByName(heads)
    runs = settled("run").groupBy("row_a").agg(F.sum("n").alias("n_copies"))
    return copies, runs
