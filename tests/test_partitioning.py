from pyspark.sql import functions as F

from ragframe.operators.partitioning import spread
from ragframe.operators.sizing import fits_broadcast, measured_rows


def test_spread_only_under_partitioned_inputs(spark):
    par = spark.sparkContext.defaultParallelism
    one = spark.range(0, 100, numPartitions=1)
    assert spread(one).rdd.getNumPartitions() == 2 * par
    many = spark.range(0, 100, numPartitions=4 * par)
    assert spread(many) is many                        # no shuffle added
    plan = spread(many)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_size_gate_measures_rows_and_dimension(spark):
    df = spark.range(0, 10).select(F.array_repeat(F.lit(1.0).cast("float"), 32).alias("v"))
    assert measured_rows(df, "v") == (10, 32)
    assert fits_broadcast(df, 64, "v", max_bytes=10 * (64 + 32 * 4))
    assert not fits_broadcast(df, 64, "v", max_bytes=10 * (64 + 32 * 4) - 1)
