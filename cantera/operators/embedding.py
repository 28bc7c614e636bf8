"""Vectors of tags and targets through a plug-in, and their cosines.

The plug-in is a function that loads an ``Embedder``; each worker calls it once. Vectors of
targets are made from their descriptions, or "<target> music"; vectors of tags are
remembered, so a worker encodes a distinct tag once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cantera.operators.matcher import Vocabulary

REMEMBERED = 100_000
SIMILARITY = T.ArrayType(T.ArrayType(T.DoubleType()))


class Embedder(Protocol):
    """Anything that turns texts into vectors of one length, as rows of an array."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


def target_texts(targets: tuple[str, ...], descriptions: Mapping[str, str] | None = None) -> list[str]:
    """What is encoded for each target."""
    return [(descriptions or {}).get(t, f"{t} music") for t in targets]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; a length counts as 1e-9 at least."""
    vectors = np.asarray(vectors, np.float64)
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-9)


class _Worker:
    """An embedder with the targets' vectors and the tags met so far."""

    def __init__(self, load: Callable[[], Embedder], texts: list[str]):
        self.model = load()
        self.targets = unit(self.model.encode(texts))
        self.place: dict[str, int] = {}
        self.vectors = np.empty((0, self.targets.shape[1]))

    def tags(self, tags: list[str]) -> np.ndarray:
        """Cosines of the distinct tags (rows) to the targets (columns)."""
        if len(self.place) + len(tags) > REMEMBERED:
            self.place, self.vectors = {}, self.vectors[:0]
        new = [t for t in tags if t not in self.place]
        if new:
            self.place.update({t: len(self.place) + i for i, t in enumerate(new)})
            self.vectors = np.concatenate([self.vectors, unit(self.model.encode(new))])
        return self.vectors[[self.place[t] for t in tags]] @ self.targets.T


def with_similarity(
    df: DataFrame,
    tags: str,
    vocabulary: Vocabulary,
    load: Callable[[], Embedder],
    into: str = "similarity",
    descriptions: Mapping[str, str] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """``df`` with, for each target in vocabulary order, the cosines to the row's tags.

    Null tags must have been dropped. A row without tags, or any row if no embedder can be
    loaded, gets null: then only letters match. ``digits`` rounds the cosines.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(into, SIMILARITY)])
    at, columns, texts = df.columns.index(tags), df.columns, target_texts(vocabulary.targets, descriptions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            worker = _Worker(load, texts)
        except Exception:  # noqa: BLE001 - without a model there are no vectors
            worker = None
        kind = pa.list_(pa.list_(pa.float64()))
        for batch in batches:
            rows = [None] * batch.num_rows
            if worker is not None:
                lists = batch.column(at)
                distinct = pc.unique(pc.list_flatten(lists)).drop_null().to_pylist()
                sims = worker.tags(distinct) if distinct else np.empty((0, len(texts)))
                if digits is not None:
                    sims = np.round(sims, digits)
                place = {t: i for i, t in enumerate(distinct)}
                rows = [sims[[place[t] for t in r]].T.tolist() if r else None for r in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*columns, into])

    return df.mapInArrow(run, schema)


def cosines(df: DataFrame, key: str, vector: str, targets: list[list[float]]) -> DataFrame:
    """(key, target, cosine) of each vector and each of a few target vectors, by one matrix
    product for each batch. Vectors must be as long as the targets; a null one has no rows."""
    columns = unit(np.array(targets)).T
    schema = T.StructType([df.schema[key], T.StructField("target", T.IntegerType()), T.StructField("cosine", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            flat = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False)
            sims = unit(flat.reshape(batch.num_rows, columns.shape[0])) @ columns
            n, k = sims.shape
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(n), k)))
            places = pa.array(np.tile(np.arange(k, dtype=np.int32), n))
            yield pa.RecordBatch.from_arrays([keys, places, pa.array(sims.ravel())], names=[key, "target", "cosine"])

    return df.select(key, vector).mapInArrow(run, schema)
