"""Incremental validation: folders into which CoNLL-U files arrive are checked sentence by sentence, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators import checks
from arborlake.sources import files


def sentences(spark: SparkSession, folder: str, language: str) -> DataFrame:
    """file, lang, raw (with the line that ends it) of every sentence in .conllu files that arrive in the folder."""
    return files.arriving(spark, folder).select("file", F.lit(language).alias("lang"), "raw")


def incidents(spark: SparkSession, folder: str, language: str, level: int = 5) -> DataFrame:
    """Findings of each sentence alone; what spans sentences is in streaming.between."""
    return checks.incidents(checks.validate(sentences(spark, folder, language), ("file", "lang"), level=level, whole=False))
