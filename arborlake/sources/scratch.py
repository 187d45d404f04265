"""Tables and files that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path, not there yet, below spark.checkpoint.dir; where that is unset (tests, on one machine) below a temporary folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors share no folder")
        shared = getattr(spark, "_arborlake_folder", None)
        if shared is None:
            shared = spark._arborlake_folder = "file://" + tempfile.mkdtemp(prefix="arborlake-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is written and read again: its size is known, and a lost executor costs a reread."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
