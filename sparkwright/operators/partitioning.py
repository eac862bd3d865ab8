"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_if_narrow(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` over all cores when it has fewer partitions than the session has cores.

    For CPU-heavy row-local work (text parsing) on an input stored as a few large row groups. On a large
    input the partitions far outnumber the cores and this is a no-op, so no shuffle is added where the
    scan is already parallel.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        narrow = df.rdd.getNumPartitions() < cores
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a Spark Connect session): leave the plan as it is
        return df
    return df.repartition(cores) if narrow else df
