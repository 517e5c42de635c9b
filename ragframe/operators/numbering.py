"""Global running numbers without a single-partition window.

``Window.orderBy(x)`` without a partition moves every row into one task.
Here the rows are range-partitioned and written with their partition's number
to the shared checkpoint folder, so that sums and totals are about the same
partitions. Each partition computes local running sums, the per-partition totals
(one row per partition) get their offsets, and a broadcast join adds them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragframe.session import scratch_path


def global_offsets(df: DataFrame, order_cols: list[str], count_col: str,
                   out_col: str = "offset", partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = sum of ``count_col`` over all rows before this one in
    ``order_cols`` order (exclusive prefix sum), computed in parallel."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    # a range partitioning samples its bounds anew for each plan it is in: do it once
    path = scratch_path(df.sparkSession, "ranged")
    df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    w = (Window.partitionBy("_pid").orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn("_local", F.sum(count_col).over(w) - F.col(count_col))
    totals = ranged.groupBy("_pid").agg(F.sum(count_col).alias("_tot"))
    # one row per partition: a bounded table, so a global window is fine here
    tw = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.withColumn("_base", F.coalesce(F.sum("_tot").over(tw), F.lit(0))).select("_pid", "_base")
    return (local.join(F.broadcast(offs), "_pid")
            .withColumn(out_col, (F.col("_base") + F.col("_local")).cast("long"))
            .drop("_pid", "_local", "_base"))
