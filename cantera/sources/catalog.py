"""The library catalogue: exports of a media server, file listings, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.functions.text import or_empty

EXPORT = """ratingKey STRING, title STRING, grandparentTitle STRING, originalTitle STRING, parentTitle STRING,
    moods ARRAY<STRUCT<tag: STRING>>, media ARRAY<STRUCT<parts: ARRAY<STRUCT<file: STRING>>>>"""


def from_export(export: DataFrame) -> DataFrame:
    """Track items from a server's export: the artist is the album artist or else the
    original one, the path is the first file's or empty."""
    first_file = F.get(F.get(F.col("media"), F.lit(0))["parts"], F.lit(0))["file"]
    return export.select(
        F.coalesce("ratingKey", F.lit("")).alias("rating_key"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(F.nullif("grandparentTitle", F.lit("")), "originalTitle", F.lit("")).alias("artist"),
        F.coalesce("parentTitle", F.lit("")).alias("album"),
        F.coalesce(first_file, F.lit("")).alias("file_path"),
        F.array_compact(F.transform(or_empty(F.col("moods"), "struct<tag:string>"), lambda m: m["tag"])).alias("current_moods"),
    )


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return from_export(spark.read.schema(EXPORT).json(path))


def file_listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return files.load(folder).select(F.regexp_replace("path", "^file:", "").alias("path"), "length", "modificationTime")
