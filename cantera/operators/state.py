"""Keyed state: upsert, statistics, and a log of batches that survives a lost run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = (
    "rating_key string, title string, artist string, mapped_mood string, confidence double, source string, "
    "processed_at timestamp_ntz"
)


def last_by_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key in the given total order; map-side maximum, so that a key
    with any number of rows costs one row a task."""
    others = [c for c in rows.columns]
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
        .select(*[F.col("_last")[c].alias(c) for c in others])
    )


def upsert(old: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """``old`` with the last row of each key of ``new`` in place of its own.

    Rows with a null key are not kept. An empty ``new`` changes nothing.
    """
    fresh = last_by_key(new.where(F.col(key).isNotNull()), key, order)
    return old.join(fresh.select(key), key, "left_anti").select(*fresh.columns).unionByName(fresh)


def state_stats(state: DataFrame) -> DataFrame:
    """One row: total_processed, mapped, unmapped."""
    total, mapped = F.count(F.lit(1)), F.count("mapped_mood")
    return state.agg(total.alias("total_processed"), mapped.alias("mapped"), (total - mapped).alias("unmapped"))


#: A total order of results of one key, whatever partitions they come from; rows equal in it are the same.
ORDER = ("processed_at", "mapped_mood", "confidence", "source", "title", "artist")


class StateStore:
    """A log of batches as Parquet folders: a batch costs what it holds, not what the state holds.

    Each save writes its batch beside the others, under a name that does not count yet, and
    then renames it to the next number, which is done at once or not at all: a run that
    ends in between loses its own batch and nothing else, and of two writers that
    want one number one takes the next. Reading takes the last batch of each key. When
    more than ``most`` batches have come together, they are put into one.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 32):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _folders(self) -> tuple[int, list[int]]:
        """The number up to which everything is in one folder, and the batches after it."""
        fs, root = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        numbers = {kind: sorted(int(n[1:]) for n in names if n[0] == kind and n[1:].isdigit()) for kind in "cv"}
        base = numbers["c"][-1] if numbers["c"] else 0
        return base, [n for n in numbers["v"] if n > base]

    def versions(self) -> list[int]:
        """Numbers of the batches that count, the compacted ones as their last."""
        base, batches = self._folders()
        return [*([base] if base else []), *batches]

    def next_version(self) -> int:
        return (self.versions() or [0])[-1] + 1

    def read(self) -> DataFrame:
        """The current state; an empty one of the right columns if there is none."""
        base, batches = self._folders()
        names = [*([f"c{base}"] if base else []), *(f"v{n}" for n in batches)]
        if not names:
            return self.spark.createDataFrame([], STATE)
        if len(names) == 1:
            return self.spark.read.parquet(f"{self.path}/{names[0]}")
        parts = [self.spark.read.parquet(f"{self.path}/{n}").withColumn("_batch", F.lit(i)) for i, n in enumerate(names)]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part, allowMissingColumns=True)
        return last_by_key(every, "rating_key", ["_batch"]).drop("_batch")

    def processed_keys(self) -> DataFrame:
        return self.read().select("rating_key").distinct()

    def is_processed(self, rating_key: str) -> bool:
        return not self.read().where(F.col("rating_key") == rating_key).isEmpty()

    def save(self, results: DataFrame, order: list | None = None, compact: bool = True) -> int:
        """Adds a batch, the last row of each key in a total order; its number. Who still
        reads an earlier state must not let it ``compact``."""
        fs, root = self._fs()
        fresh = last_by_key(results.where(F.col("rating_key").isNotNull()), "rating_key", list(order or ORDER))
        own = f"_{uuid.uuid4().hex}"
        fresh.write.parquet(f"{self.path}/{own}")
        while True:
            number = self.next_version()
            if not fs.exists(self._path(f"v{number}")) and fs.rename(self._path(own), self._path(f"v{number}")):
                break
        if compact:
            self.compact()
        return number

    def compact(self) -> None:
        """Puts more than ``most`` batches into one folder; they are removed only when it counts."""
        fs, _ = self._fs()
        base, batches = self._folders()
        if len(batches) <= self.most:
            return
        own = f"_{uuid.uuid4().hex}"
        self.read().write.parquet(f"{self.path}/{own}")
        if fs.rename(self._path(own), self._path(f"c{batches[-1]}")):
            for old in [*([f"c{base}"] if base else []), *(f"v{n}" for n in batches)]:
                fs.delete(self._path(old), True)

    def stats(self) -> DataFrame:
        return state_stats(self.read())
