"""What depends on the running session."""

from __future__ import annotations

from pyspark.sql import DataFrame


def widened(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that costs far more than moving the rows.

    A single small file is one partition; inputs of a cluster's size have more partitions than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
