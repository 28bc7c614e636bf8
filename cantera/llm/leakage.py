"""Evaluation texts inside a corpus: broadcast n-gram set, window scan, verification.

Words are longest runs of letters and digits in lower case. The evaluation set
is turned once into word ids and a sorted array of hashed n-grams. Every corpus
batch is tokenised in Arrow, its words are looked up in the evaluation
vocabulary (an unknown word is -1), windows of n known words are hashed, looked
up, and each hit is verified id by id, so hash collisions report nothing. Words are
split as they are stored and lowered one by one, so places in the text are never moved
by a letter whose lower case is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NON_WORD = r"[^\p{L}\p{Nd}]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokenise(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat array of words and the row each word belongs to; null rows have none."""
    flat, rows = stored_words(texts)
    return pc.utf8_lower(flat), rows


def stored_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same words as they are written."""
    parts = pc.split_pattern_regex(pc.fill_null(texts, ""), NON_WORD)
    flat = pc.list_flatten(parts)
    rows = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    keep = pc.not_equal(flat, "")
    return flat.filter(keep), rows[keep.to_numpy(zero_copy_only=False)]


def window_hash(ids: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash per window of n ids."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.full(m, 0xCBF29CE484222325, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ ids[k : k + m].astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
    return h


@dataclass
class GramIndex:
    """The evaluation side; its size is that of the evaluation set."""

    n: int
    vocabulary: pa.Array
    hashes: np.ndarray  # sorted
    grams: np.ndarray  # ids, one row per hash
    items: np.ndarray  # item of each gram

    @staticmethod
    def build(item_ids: list[int], texts: list[str | None], n: int) -> GramIndex:
        words, rows = tokenise(pa.array(texts, pa.string()))
        words = words.dictionary_encode()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        h = window_hash(ids, n)
        m = len(h)
        inside = rows[:m] == rows[n - 1 :][:m] if m else np.empty(0, bool)
        at = np.flatnonzero(inside)
        owner = np.asarray(item_ids, np.int64)[rows[at]] if len(at) else np.empty(0, np.int64)
        grams = ids[at[:, None] + np.arange(n)] if len(at) else np.empty((0, n), np.int64)
        once = np.unique(np.concatenate([owner[:, None], grams], axis=1), axis=0, return_index=True)[1]  # a gram counts once an item
        once = once[np.argsort(h[at[once]], kind="stable")]
        return GramIndex(n, words.dictionary, h[at[once]], grams[once], owner[once])

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Verified hits: row, index of the window's first word in the row, item, and
        the index of that word in the flat list."""
        none = (np.empty(0, np.int64),) * 4
        words, rows = tokenise(texts)
        if not len(words) or not len(self.hashes):
            return none
        ids = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1)
        ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        n, m = self.n, len(ids) - self.n + 1
        if m <= 0:
            return none
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        ok = (unknown[n:] == unknown[:m]) & (rows[:m] == rows[n - 1 :])
        at = np.flatnonzero(ok)
        if not len(at):
            return none
        runs = ids[at[:, None] + np.arange(n)]
        h = np.full(len(at), 0xCBF29CE484222325, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ runs[:, k].astype(np.uint64)) * _MIX
                h ^= h >> np.uint64(29)
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        count = hi - lo
        which = np.repeat(np.arange(len(at)), count)
        gram = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        same = (runs[which] == self.grams[gram]).all(axis=1)
        which, gram = which[same], gram[same]
        first = np.searchsorted(rows, rows, "left")
        return rows[at[which]], at[which] - first[at[which]], self.items[gram], at[which]


def _collect_items(items: DataFrame, item_id: str, text: str, max_words: int):
    """Ids and texts of the items, if all their words together are few enough."""
    rows = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    words = rows.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{Nd}]+"))), F.sum(F.length("text"))).first()
    if (words[0] or 0) > max_words or (words[1] or 0) > 16 * max_words:
        return None
    got = rows.collect()
    return [r[0] for r in got], [r[1] for r in got]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    max_broadcast_words: int = 1_000_000,
) -> DataFrame:
    """(doc_id, item_id, n_windows): the documents holding n consecutive words of an item.

    The words of the evaluation set are counted before it is broadcast; beyond
    ``max_broadcast_words`` (about 100 bytes each, or 16 characters a word on average) the
    hashed n-grams of both sides are joined by a shuffle and the hits verified on the texts,
    with the same result. Null or empty texts, texts shorter than n words and items shorter
    than n words give no rows; a document id occurring on several rows is reported once
    per item with the windows of all its rows; a null document id stays null. A place of a
    document counts once an item, however often the item repeats its words. Other columns
    are not read.
    """
    got = _collect_items(items, item_id, item_text, max_broadcast_words)
    if got is None:
        hits = _verified_hits(docs, items, doc_id, text, item_id, item_text, n)
        return hits.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"))
    index = docs.sparkSession.sparkContext.broadcast(GramIndex.build(*got, n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, item, _ = index.value.scan(batch.column(1))
            if not len(row):
                continue
            pairs, count = np.unique(np.stack([row, item], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1]), pa.array(count.astype(np.int64))],
                names=["doc_id", "item_id", "n_windows"],
            )

    hits = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(
        scan, "doc_id bigint, item_id bigint, n_windows bigint"
    )
    return hits.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"))


# Evaluation sets too large to broadcast


def _hashed_grams(n: int, with_text: bool):
    """(id, text) → (id, hash[, gram]) of every n words in a row, each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, rows = tokenise(batch.column(1))
            m = len(words) - n + 1
            if m <= 0:
                continue
            words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
            # a word is known by its letters, so that both sides hash alike
            spelled = words.dictionary_encode()
            code = np.array([int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") for w in spelled.dictionary.to_pylist()], np.uint64)
            ids = code[spelled.indices.to_numpy(zero_copy_only=False)]
            at = np.flatnonzero(rows[:m] == rows[n - 1 :])
            h = window_hash(ids, n)[at].view(np.int64)
            columns, names = [batch.column(0).take(pa.array(rows[at])), pa.array(h)], ["id", "hash"]
            if with_text:
                spelt = words.to_pylist()
                columns, names = [*columns, pa.array([" ".join(spelt[i : i + n]) for i in at.tolist()], pa.string())], [*names, "gram"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _places(n: int):
    """(doc_id, text, grams array<struct<item, gram>>) → verified (doc_id, item_id, first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, rows = tokenise(batch.column(1))
            spelt, ends = words.to_pylist(), np.searchsorted(rows, np.arange(batch.num_rows + 1)).tolist()
            out: list[tuple[int, int, int]] = []
            for r, grams in enumerate(batch.column(2).to_pylist()):
                wanted: dict[str, list[int]] = {}
                for g in grams:
                    wanted.setdefault(g["gram"], []).append(g["item_id"])
                own = spelt[ends[r] : ends[r + 1]]
                out += [(r, item, i) for i in range(len(own) - n + 1) for item in wanted.get(" ".join(own[i : i + n]), ())]
            row, item, first = (pa.array([x[k] for x in out], pa.int64()) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), item, first], names=["doc_id", "item_id", "first"])

    return run


def _grams_met(docs, items, doc_id, text, item_id, item_text, n) -> DataFrame:
    """(doc_id, grams): the n-grams of items whose hash occurs in a document, at most the
    document's own windows and the items that hold them."""
    left = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).where(F.col(doc_id).isNotNull())
    left = left.mapInArrow(_hashed_grams(n, False), "id bigint, hash bigint").select(F.col("id").alias("doc_id"), "hash")
    right = items.select(F.col(item_id).cast("bigint"), F.col(item_text).cast("string")).where(F.col(item_id).isNotNull())
    right = right.mapInArrow(_hashed_grams(n, True), "id bigint, hash bigint, gram string").distinct()
    met = left.join(right, "hash").select("doc_id", F.struct(F.col("id").alias("item_id"), "gram").alias("g"))
    return met.groupBy("doc_id").agg(F.collect_set("g").alias("grams"))


def _verified_hits(docs, items, doc_id, text, item_id, item_text, n) -> DataFrame:
    """(doc_id, item_id, first): every place of a document that holds n words of an item."""
    met = _grams_met(docs, items, doc_id, text, item_id, item_text, n)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).join(met, "doc_id")
    return rows.mapInArrow(_places(n), "doc_id bigint, item_id bigint, first bigint")


def _without(text: str, first: np.ndarray, n: int) -> tuple[str, int]:
    """The text without the runs of n words that begin at the places ``first``."""
    words = stored_words(pa.array([text], pa.string()))[0].to_pylist()
    hit = np.zeros(len(words), bool)
    for f in first:
        hit[f : f + n] = True
    out, kept, at, before = [], 0, 0, False
    for word, cut in zip(words, hit.tolist()):
        begin = text.index(word, at)  # what lies between two words holds no letter of one
        if cut and not before:
            out.append(text[kept:begin])
        if not cut and before:
            kept = at
        at, before = begin + len(word), cut
    out.append(text[at if before else kept :])
    clean = "".join(out)
    return clean, len(text) - len(clean)


def remove_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    max_broadcast_words: int = 1_000_000,
) -> DataFrame:
    """(doc_id, text, n_removed): every row of ``docs`` with the leaked spans cut out.

    A span reaches from the first letter of the first word to the last letter of
    the last word of a run of hits; what lies around it stays as it is stored. Rows without
    hits keep their text, null texts stay null. An evaluation set of more than
    ``max_broadcast_words`` words is joined by a shuffle, with the same result; rows with
    a null id are left as they are then.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id bigint, text string, n_removed bigint"
    got = _collect_items(items, item_id, item_text, max_broadcast_words)
    if got is not None:
        index = docs.sparkSession.sparkContext.broadcast(GramIndex.build(*got, n))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if got is not None:
                row, first, _, _ = index.value.scan(batch.column(1))
            else:
                numbers = pa.array(np.arange(batch.num_rows))
                found = list(_places(n)(iter([pa.RecordBatch.from_arrays([numbers, batch.column(1), batch.column(2)], names=["doc_id", "text", "grams"])])))
                row, first = (np.concatenate([f.column(k).to_numpy(zero_copy_only=False) for f in found]).astype(np.int64) for k in (0, 2))
            texts = batch.column(1)
            removed = np.zeros(batch.num_rows, np.int64)
            if len(row):
                changed = texts.to_pylist()
                for r in np.unique(row):
                    changed[r], removed[r] = _without(changed[r], first[row == r], n)
                texts = pa.array(changed, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(removed)], names=["doc_id", "text", "n_removed"])

    if got is not None:
        return rows.mapInArrow(cut, schema)
    met = _grams_met(docs, items, doc_id, text, item_id, item_text, n)
    nothing = F.array().cast("array<struct<item_id:bigint,gram:string>>")
    return rows.join(met, "doc_id", "left").select("doc_id", "text", F.coalesce("grams", nothing).alias("grams")).mapInArrow(cut, schema)
