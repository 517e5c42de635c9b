"""Parallelism for CPU-heavy row-local steps."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, target: int | None = None, factor: int = 2) -> DataFrame:
    """Round-robin ``df`` over ``factor x defaultParallelism`` partitions, but
    only when its current plan has fewer partitions than the cluster has
    cores (e.g. one small file = one task). A large input split by the scan
    is returned unchanged, so no shuffle is added at scale."""
    sc = df.sparkSession.sparkContext
    target = target or factor * sc.defaultParallelism
    if df.rdd.getNumPartitions() < sc.defaultParallelism:
        return df.repartition(target)
    return df
