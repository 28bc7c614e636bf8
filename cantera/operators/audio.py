"""What follows audio inference: pooling, gates, label mapping, tempo.

Inference itself is a plug-in (see ``AudioModel``): an object with labels and a
function from a batch of file contents to frames of scores.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantera.functions.text import bound, constant, one_of, or_empty, strings
from cantera.operators.matcher import MOODS, PRIMARY, SUB, Vocabulary, lookup, match_tags, targets_of
from cantera.plans import vocab as V

TOP = "array<struct<label:string,score:double>>"


class AudioModel(Protocol):
    """Loaded once in every worker; must be picklable before that."""

    labels: list[str]

    def frames(self, content: bytes) -> list[list[float]]: ...


def infer(files: DataFrame, model: AudioModel, key: str = "path") -> DataFrame:
    """(key, frame, scores) from a ``binaryFile`` frame; a file the model fails on gives no rows."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf[key], pdf["content"]):
                try:
                    rows += [(name, i, [float(x) for x in f]) for i, f in enumerate(model.frames(bytes(content)))]
                except Exception:  # noqa: BLE001 - any failure of a model means no prediction
                    continue
            yield pd.DataFrame(rows, columns=["key", "frame", "scores"])

    return files.select(key, "content").mapInPandas(run, "key string, frame int, scores array<double>")


@dataclass
class TwoStage:
    """A model of two parts: vectors of a recording's frames, and a head that scores them."""

    labels: list[str]
    embed: Callable[[bytes], list[list[float]]]
    head: Callable[[list[list[float]]], list[list[float]]]

    def frames(self, content: bytes) -> list[list[float]]:
        return self.head(self.embed(content))


#: The models looked for, in this order, where the configured one is missing.
FALLBACK_MODELS = ("mtg_jamendo_moodtheme-discogs-effnet-1.pb", "genre_discogs400-discogs-effnet-1.pb")
#: A smaller graph or description is no real one.
LEAST_GRAPH, LEAST_DESCRIPTION = 10_000, 100


def chosen_model(folder: str, configured: str) -> str | None:
    """The path of the configured model, else of a fallback, else none; files too small to be
    a graph do not count."""
    wanted = Path(folder, configured)
    if configured and wanted.is_file() and wanted.stat().st_size >= LEAST_GRAPH:
        return str(wanted)
    for name in FALLBACK_MODELS:
        path = Path(folder, name)
        if path.is_file() and path.stat().st_size > LEAST_GRAPH:
            return str(path)
    return None


def model_description(path: str) -> dict:
    """labels, input, output and two_stage of a model, from the JSON file beside it where that is real."""
    found = {"labels": [], "input": "serving_default_model_Placeholder", "output": "PartitionedCall:0", "two_stage": "effnet" in Path(path).name.lower()}
    beside = Path(path).with_suffix(".json")
    if not beside.is_file() or beside.stat().st_size <= LEAST_DESCRIPTION:
        return found
    try:
        about = json.loads(beside.read_text(encoding="utf-8"))
        ports = about.get("schema", {})
        named = [x["name"] for x in ports.get("inputs", [])[:1] if "name" in x]
        outputs = ports.get("outputs", [])
        scores = [x for x in outputs if x.get("output_purpose") == "predictions"] or outputs
        told = [x["name"] for x in scores[:1] if "name" in x]
        return found | {"labels": about.get("classes", [])} | ({"input": named[0]} if named else {}) | ({"output": told[0]} if told else {})
    except (ValueError, AttributeError, TypeError):
        return found


def tempo(files: DataFrame, detectors: list[Callable[[bytes], float | None]], key: str = "path") -> DataFrame:
    """(key, bpm) from a ``binaryFile`` frame: the first detector that finds a positive tempo
    counts, rounded half to even; a detector that fails finds none."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            found = []
            for content in pdf["content"]:
                bpm = None
                for detect in detectors:
                    try:
                        bpm = round(float(detect(bytes(content)) or 0)) or None
                    except Exception:  # noqa: BLE001 - the next one is asked
                        bpm = None
                    if bpm and bpm > 0:
                        break
                    bpm = None
                found.append(bpm)
            yield pd.DataFrame({key: pdf[key], "bpm": pd.array(found, "Int32")})

    return files.select(key, "content").mapInPandas(run, f"`{key}` string, bpm int")


def pooled(frames: DataFrame, key: str, scores: str) -> DataFrame:
    """(key, class, score): the mean of every class over a key's frames, combined map-side."""
    return (
        frames.select(key, F.posexplode(scores).alias("class", "value"))
        .groupBy(key, "class")
        .agg(F.avg(F.col("value").cast("double")).alias("score"))
    )


def top_classes(means: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k best classes of a key with their rank from 1; ties go to the higher class."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("class"))
    return means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_labels(ranked: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """(key, top): the ranked classes of a key as labelled predictions, best first."""
    named = F.struct("rank", F.get(strings(labels), F.col("class")).alias("label"), "score")
    top = F.transform(F.array_sort(F.collect_list(named)), lambda p: F.struct(p["label"].alias("label"), p["score"].alias("score")))
    return ranked.groupBy(key).agg(top.alias("top"))


def _label(p: Column) -> Column:
    return F.lower(p["label"])


def _mood_map() -> Column:
    return constant(V.AUDIO_LABEL_MOODS, "map<string,string>")


def mapped_label(label: Column) -> Column:
    """The mood a label stands for, null if none."""
    return F.try_element_at(_mood_map(), F.lower(label))


def confident(top: Column, targets: tuple[str, ...] = MOODS.targets) -> Column:
    """Predictions to rely on: labels of wanted moods from .05, love and melodic from .16,
    others from .10; if there are none, all but melodic from .08. General labels never."""
    wanted = tuple(k for k, v in V.AUDIO_LABEL_MOODS.items() if v.lower() in {t.lower() for t in targets})
    distinct = F.filter(or_empty(top, TOP[6:-1]), lambda p: ~one_of(_label(p), V.AUDIO_GENERIC_LABELS))

    def gate(p: Column) -> Column:
        by_label = F.when(_label(p).isin("love", "melodic"), p["score"] >= 0.16).otherwise(p["score"] >= 0.10)
        return one_of(_label(p), wanted) & (p["score"] >= 0.05) | by_label if wanted else by_label

    def relaxed(p: Column) -> Column:
        return (_label(p) != "melodic") & (p["score"] >= 0.08)

    return bound(
        distinct,
        lambda d: bound(F.filter(d, gate), lambda c: F.when(F.size(c) > 0, c).otherwise(F.filter(d, relaxed))),
    )


def label_moods(predictions: Column, vocabulary: Vocabulary = MOODS, labels: Sequence[str] = ()) -> Column:
    """Moods of predictions in their order, each once; labels without an entry are matched as
    tags: the model's ``labels`` when the plan is made, others row by row."""
    known = {x: [target for target, *_ in lookup(vocabulary).match([x], 3)] for x in labels if x.lower() not in V.AUDIO_LABEL_MOODS}

    def moods(p: Column) -> Column:
        return F.coalesce(
            F.when(mapped_label(p["label"]).isNotNull(), F.array(mapped_label(p["label"]))),
            *([F.try_element_at(constant(known, "map<string,array<string>>"), p["label"])] if known else []),
            targets_of(match_tags(F.array(p["label"]), vocabulary)),
        )

    return F.array_distinct(F.flatten(F.transform(predictions, moods)))


def tempo_valid(moods: Column, bpm: Column) -> Column:
    """Drops energetic below 130, lively below 115, and relaxed, calm and mellow above 120."""

    def off(m: Column) -> Column:
        low = F.lower(m)
        return (
            ((low == "energetic") & (bpm < 130)) | ((low == "lively") & (bpm < 115)) | (low.isin("relaxed", "calm", "mellow") & (bpm > 120))
        )

    return F.when(bpm.isNull(), moods).otherwise(F.filter(moods, lambda m: ~off(m)))


def supported(moods: Column, bpm: Column) -> Column:
    """Energetic and lively stay only beside a specific mood or at their own tempo."""

    def has(*values: str) -> Column:
        return F.exists(moods, lambda m: one_of(F.lower(m), values))

    keep = (
        has(*V.AUDIO_SUPPORT_MOODS)
        | (F.coalesce(bpm >= 130, F.lit(False)) & has("energetic"))
        | (F.coalesce((bpm >= 110) & (bpm < 130), F.lit(False)) & has("lively"))
    )
    return F.when(keep, moods).otherwise(F.filter(moods, lambda m: ~F.lower(m).isin("energetic", "lively")))


def matched_score(predictions: Column, moods: Column, best: Column) -> Column:
    """The best score of a prediction whose mood survived; if that is 0, the overall best."""
    surviving = F.filter(predictions, lambda p: F.coalesce(F.array_contains(moods, mapped_label(p["label"])), F.lit(False)))
    score = F.coalesce(F.greatest(F.array_max(F.transform(surviving, lambda p: p["score"])), F.lit(0.0)), F.lit(0.0))
    return F.when((score == 0.0) & (F.size(moods) > 0), best).otherwise(score)


def audio_moods(top: Column, bpm: Column, vocabulary: Vocabulary = MOODS, least: float = 0.1, labels: Sequence[str] = ()) -> Column:
    """STRUCT<moods, score, accepted>: moods of a track's top predictions; ``labels`` are those
    of the model, where they are known.

    ``accepted`` are the moods if their score reaches ``least``, else none. If no mood
    is left, wanted moods named inside a label are told, with the score found so far.
    """

    def settle(c: Column, t: Column) -> Column:
        found = bound(label_moods(c, vocabulary, labels), lambda m: bound(tempo_valid(m, bpm), lambda v: supported(v, bpm)))

        def told(m: Column) -> Column:
            best = F.coalesce(F.array_max(F.transform(t, lambda p: p["score"])), F.lit(0.0))
            direct = F.filter(
                strings(vocabulary.targets), lambda x: F.exists(t, lambda p: F.contains(_label(p), F.lower(x)))
            )
            moods = F.when(F.size(m) > 0, m).otherwise(direct)
            return bound(
                F.struct(moods.alias("moods"), matched_score(c, m, best).alias("score")),
                lambda r: F.struct(
                    r["moods"].alias("moods"), r["score"].alias("score"),
                    F.when(r["score"] >= least, r["moods"]).otherwise(F.slice(r["moods"], 1, 0)).alias("accepted"),
                ),
            )

        return bound(found, told)

    return bound(or_empty(top, TOP[6:-1]), lambda t: bound(confident(t, vocabulary.targets), lambda c: settle(c, t)))


def unlabelled_mood(scores: Column, targets: tuple[str, ...] = MOODS.targets) -> Column:
    """For a model without labels: the target at the place of the highest positive score."""
    first = F.slice(scores, 1, len(targets))
    return bound(
        F.array_max(first),
        lambda best: F.when(best > 0, F.array(F.get(strings(targets), F.array_position(first, best).cast("int") - 1))).otherwise(
            F.array().cast("array<string>")
        ),
    )


def genre_label(label: Column) -> Column:
    """STRUCT<genre, style> of a label ``genre---style``; without a style the genre is both."""

    def named(parts: Column) -> Column:
        genre = F.trim(F.get(parts, F.lit(0)))
        style = F.coalesce(F.trim(F.get(parts, F.lit(1))), genre)
        known = F.when(F.contains(genre, F.lit("Folk")), "Folk").when(F.contains(genre, F.lit("Hip Hop")), "Hip-Hop")
        return F.struct(known.otherwise(genre).alias("genre"), style.alias("style"))

    return bound(F.split(label, "---"), named)


def audio_genres(top: Column) -> Column:
    """STRUCT<genre, sub_genres> of a track's top predictions from .10 on."""

    def told(parts: Column) -> Column:
        genres = F.transform(parts, lambda p: p["genre"])
        styles = F.transform(parts, lambda p: p["style"])

        def lifted(subs: Column, genre: Column) -> Column:
            def says(word: str) -> Column:
                return F.exists(F.concat(subs, styles), lambda s: F.contains(F.lower(s), F.lit(word)))

            return F.when(F.size(subs) == 0, genre).when(says("punk"), "Punk").when(says("metal"), "Metal").otherwise(genre)

        return bound(
            targets_of(match_tags(styles, SUB)),
            lambda subs: F.struct(
                lifted(subs, F.get(targets_of(match_tags(genres, PRIMARY)), F.lit(0))).alias("genre"), subs.alias("sub_genres")
            ),
        )

    sure = F.filter(or_empty(top, TOP[6:-1]), lambda p: p["score"] >= 0.10)
    return bound(F.transform(sure, lambda p: genre_label(p["label"])), told)


def whole_bpm(raw: Column) -> Column:
    """Tempo rounded half to even; null if it is missing, not a number or not positive."""
    rounded = F.when(F.isnan(raw) | (F.abs(raw) > 1e9), None).otherwise(F.bround(raw, 0)).cast("int")
    return F.when(rounded > 0, rounded)
