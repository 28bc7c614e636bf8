"""The queries over the driver's tables; each runs an operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.llm import canon, cooccurrence, formatting, frequency, leakage, lookalike, mixing, names, spans
from cantera.session import table

#: Where the public tokenizer's file lies on every machine.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.map_tags_and_moods(
        table(spark, d, "track_items"), table(spark, d, "processed_tracks"), table(spark, d, "canon_entries")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_rows(table(spark, d, "track_items"), "row_id", ["title", "artist"])


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.spelling_table(table(spark, d, "track_items"), ["title", "artist"])


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    spellings = [table(spark, d, t).select("artist") for t in ("track_items", "processed_tracks")]
    return names.spelling_classes(spellings[0].unionByName(spellings[1]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_pairs(p3_classes(spark, d))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    tracks = table(spark, d, "track_items")
    counts = frequency.term_frequencies(tracks, "raw_tags")
    total = tracks.agg(F.count(F.lit(1)).alias("n_total"))
    return frequency.mark_frequency(counts, total, rare_at_most=2, common_over=Fraction(1, 25)).withColumnRenamed("term", "tag")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms(spark, d).where("verdict <> 'useful'").select("tag", "verdict")


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return formatting.formatting_runs(table(spark, d, "track_items"), "row_id", ["title", "artist", "album"], "raw_tags")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)[0]


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)[1].withColumnRenamed("row_a", "row_id")


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    def named(kind: str, column: str):
        values = F.coalesce(F.array_compact(column), F.array().cast("array<string>"))
        return F.transform(values, lambda x: F.concat(F.lit(f"{kind}:"), x))

    return table(spark, d, "track_items").select(
        F.array_distinct(F.concat(named("tag", "raw_tags"), named("mood", "current_moods"))).alias("items")
    )


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _measured(cooccurrence.cooccurrence(_baskets(spark, d), "items", min_support=Fraction(1, 250), min_lift=3))


def _measured(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"lift": F.round("lift", 6), "llr": F.round("llr", 4)})


def p6_significant(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that meet more often than chance to one in a thousand, in a hundredth of the rows."""
    pairs = cooccurrence.cooccurrence(_baskets(spark, d), "items", min_support=Fraction(1, 100), min_lift=1, min_llr=10.83)
    return _measured(pairs)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select("item_a", "item_b")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), n=10).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), n=10)


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = mixing.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text"), "text", TOKENIZER)
    return mixing.mix(docs, table(spark, d, "source_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def _mix_by_length(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).alias("n_tokens"))
    return mixing.mix(docs, table(spark, d, "source_targets"))


def p8_mix_by_length(spark: SparkSession, d: str) -> DataFrame:
    """The mix with characters for tokens, which SQL can count."""
    return _mix_by_length(spark, d)[0].withColumnRenamed("n_tokens", "n_chars")


def p8_shares_by_length(spark: SparkSession, d: str) -> DataFrame:
    shares = _mix_by_length(spark, d)[1].withColumnRenamed("n_tokens", "n_chars")
    return shares.withColumns({c: F.round(c, 9) for c in ("target_share", "mix_share", "reached_share")})


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(*spans.shared_passages(table(spark, d, "documents"), min_length=240))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(*spans.shared_passages(table(spark, d, "documents"), min_length=240), min_length=240)


def p9_parts(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_parts(table(spark, d, "documents"), p9_spans(spark, d))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_forms, p3_found, p3_classes, p4_found, p4_terms, p5_found, p5_records, p6_found, p6_pairs, p6_significant, p7_found, p7_cleaned,
              p8_mix, p8_shares, p8_mix_by_length, p8_shares_by_length, p9_found, p9_spans, p9_parts)
}
