"""The corpus pipeline: quality, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm import common, minhash, mixing, packing, pii, quality


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written so that it stays the same."""
    return common.stored(docs.withColumn("_row", F.monotonically_increasing_id()))


def by_row(rows: DataFrame) -> DataFrame:
    """The rows with their number as doc_id: equal and null ids then stand for a row each."""
    return rows.withColumn("doc_id", F.col("_row")).drop("_row")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the classifier rejects; labels come from the labelled rows still there.

    Null and empty texts are scored like others; a table without labelled rows keeps all rows; other columns pass through.
    """
    return quality.kept(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that of least doc_id; null is after all others."""
    rows = numbered(docs)
    found = minhash.near_duplicates(by_row(rows)).select(F.col("doc_id").alias("_row"), "component_id")
    several = common.stored(found.join(found.where("component_id <> _row").select("component_id").distinct(), "component_id"))
    ranked = rows.select("_row", "doc_id").join(several, "_row").withColumn("rank", F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("first"))
    gone = several.join(first.select(F.col("first._row").alias("_row")), "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_first_copies),
    ("pii", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: Training, sketching and the linear program have no SQL form; README lists which stages tests hold against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
