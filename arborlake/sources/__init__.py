

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(table: DataFrame) -> DataFrame:
    """A scanned table, dealt over all cores where its scan has no more tasks than cores.

    A small Parquet file is one row group, hence one busy task. A large table has more tasks than cores and is not
    moved; what is moved is at most one scan task's bytes for each core.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(2 * cores) if 0 < table.rdd.getNumPartitions() <= cores else table
