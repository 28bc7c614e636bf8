"""Mixing sources to target shares: weighted fair queueing over shuffled documents.

Every document has a place in its source's shuffled order, given by a seeded hash of
its id. Its virtual finish time is the source's tokens up to and including it, over
the source's weight; its n-th use comes a whole round of the source later. Sorting
all uses by finish time interleaves the sources in proportion to their weights, so
cutting that order at any budget gives the wanted shares as long as no source runs
out. Running sums are made per range partition, with a table of one row a partition
for the sums before it: no source and no mix is ever summed up in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantera.session import checkpoint


#: How text is split before the merges of a rank file: the public pattern of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(docs: DataFrame, text: str, tokenizer: str, into: str = "n_tokens", split: str = SPLIT) -> DataFrame:
    """``docs`` without its text, with the number of tokens of the whole text.

    ``tokenizer`` is the path of a tokenizer file that every executor can read: a rank file
    (``.tiktoken``), whose text is first cut by ``split``, or a JSON file. Null and empty texts have no tokens; strings of special tokens count as ordinary text. A
    column of the new column's name is replaced.
    """
    kept = [c for c in docs.columns if c not in (text, into)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(into, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _counter(tokenizer, split)
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            texts = pc.fill_null(batch.column(len(kept)).cast(pa.large_string()), "")
            for at in range(0, batch.num_rows, 256):
                part = texts.slice(at, 256).to_pylist()
                counts[at : at + len(part)] = lengths(part)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*kept, into])

    return docs.select(*kept, F.col(text).cast("string")).mapInArrow(run, schema)


@cache
def _counter(path: str, split: str) -> Callable[[list[str]], list[int]]:
    """Loaded once in every worker."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        encoding = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path)
    encoder.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in encoder.encode_batch_fast(texts, add_special_tokens=False)]


def running_sum(df: DataFrame, group: str | None, order: list[str], value: str, into: str) -> DataFrame:
    """``df`` with the sum of the BIGINT column ``value`` up to and including each row,
    in the order ``order``, within each ``group`` or over all rows.

    The order must be total. Each range partition sums by itself in one pass; what
    comes before it is looked up in a table with one row for each partition and each
    group in it.
    """
    keys = ([group] if group else []) + order
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_sum", T.LongType())])
    at, by = df.columns.index(value), df.columns.index(group) if group else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            total = np.cumsum(batch.column(at).to_numpy(zero_copy_only=False))
            if by is None:
                total = total + carry
            else:
                g = batch.column(by)
                cut = np.ones(n, bool)
                cut[1:] = pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                first = np.maximum.accumulate(np.where(cut, np.arange(n), 0))
                before = np.concatenate([[0], total])[first]
                if g[0].as_py() == last:
                    before = np.where(first == 0, -carry, before)
                total, last = total - before, g[n - 1].as_py()
            carry = int(total[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(total)], names=[*batch.schema.names, "_part", "_sum"]
            )

    summed = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema))
    cells = ["_part"] + ([group] if group else [])
    ends = summed.groupBy(*cells).agg(F.sum(value).alias("_own"))
    window = Window.orderBy("_part") if group is None else Window.partitionBy(group).orderBy("_part")
    before = ends.withColumn("_before", F.sum("_own").over(window) - F.col("_own")).drop("_own")
    return summed.join(F.broadcast(before), cells).withColumn(into, F.col("_sum") + F.col("_before")).drop("_part", "_sum", "_before")


def mix(
    docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17, max_sources: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) from docs (doc_id, source, n_tokens) and targets (source, target_share, max_repeats).

    The mixture (doc_id, source, use, n_tokens) says how often each document is used.
    Sources are compared in lower case; documents without tokens, or whose source is
    null or not wanted, are not used. Shares are those of the sources that have
    documents, scaled to 1. Without a ``budget`` it is the largest total at which no
    source runs out; with a larger one the sources that run out fall short of their
    share, and the others do not fill up for them. A use whose finish time is beyond
    the budget is left out, and so are the first use over the budget and all after it.

    The report (source, target_share, mix_share, n_docs, n_uses, n_tokens, reached_share)
    has a row for every wanted source. Target rows with a null source, a share that is
    not positive or no allowed use want nothing; a source named twice counts once, with
    its larger share. The list of sources is counted before it is broadcast.
    """
    targets = (
        targets.select(F.lower("source").alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
        .where("source is not null and target_share > 0 and max_repeats > 0")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    small = targets.limit(max_sources + 1).count() <= max_sources
    shared = F.broadcast if small else (lambda x: x)
    docs = docs.select("doc_id", F.lower("source").alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens"))
    docs = checkpoint(docs.where("n_tokens > 0 and source is not null").join(shared(targets.select("source")), "source"))
    size = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("n_docs"))
    rates = checkpoint(targets.join(size, "source"))
    total_share = rates.agg(F.sum("target_share")).first()[0] or 1.0
    # to twelve digits, so that the order in which shares were added up makes no difference
    rates = rates.withColumn("mix_share", F.round(F.col("target_share") / F.lit(total_share), 12))
    if budget is None:  # one number of a table with one row for each source
        room = F.floor(F.col("max_repeats") * F.col("source_tokens") / F.col("mix_share") + 1e-6)
        budget = rates.agg(F.min(room)).first()[0] or 0

    placed = docs.withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), "source", "doc_id", "n_tokens")))
    placed = running_sum(placed.select("source", "place", "doc_id", "n_tokens"), "source", ["place", "doc_id", "n_tokens"], "n_tokens", "upto")
    uses = (
        placed.join(shared(rates.select("source", "max_repeats", "source_tokens", "mix_share")), "source")
        .withColumn("most", F.least("max_repeats", F.lit(2) + F.floor((F.lit(float(budget)) * F.col("mix_share") - F.col("upto")) / F.col("source_tokens"))))
        .where("most > 0")  # uses beyond the budget are not even made; the exact bound follows
        .withColumn("use", F.explode(F.sequence(F.lit(1), F.col("most").cast("int"))))
        .withColumn("finish", ((F.col("use") - 1) * F.col("source_tokens") + F.col("upto")) / F.col("mix_share"))
        .where(F.col("finish") <= F.lit(float(budget)) * (1 + 1e-9))
        .select("finish", "source", "doc_id", "use", "n_tokens")
    )
    ordered = running_sum(uses, None, ["finish", "source", "doc_id", "use", "n_tokens"], "n_tokens", "total")
    mixture = ordered.where(F.col("total") <= budget).select("doc_id", "source", F.col("use").cast("int").alias("use"), "n_tokens")
    got = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("n_uses"), F.sum("n_tokens").alias("n_tokens"))
    every = got.agg(F.sum("n_tokens").alias("all_tokens"))
    report = (
        targets.select("source", "target_share")
        .join(rates.select("source", "mix_share", "n_docs"), "source", "left")
        .join(got, "source", "left")
        .crossJoin(F.broadcast(every))  # one row
        .select(
            "source", "target_share", F.coalesce("mix_share", F.lit(0.0)).alias("mix_share"),
            *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_docs", "n_uses", "n_tokens")),
            F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"),
        )
    )
    return mixture, report
