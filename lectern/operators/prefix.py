"""Running totals over all rows in one global order (two-level prefix sum).

A window without a partition would sort everything in one task. ``running_total`` range-partitions
the rows on the order instead, sums each slice locally and adds the totals of the slices before it:
one number per slice, fewer than there are shuffle partitions. The split is checkpointed, so that it
stays the same when tasks run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: list[str], value: str, out: str = "start") -> DataFrame:
    """``df`` and the sum of ``value`` over all rows before each one. ``order`` orders the rows
    totally; pass narrow rows: they are written once to the checkpoint folder."""
    from lectern.session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()).checkpoint(eager=True)
    before = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy(F.col("_slice").alias("_of")).agg(F.sum(value).alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = slices.withColumn("_before", earlier).drop("_sum")
    return (sliced.withColumn("_local", F.coalesce(F.sum(value).over(before), F.lit(0)))
            .join(F.broadcast(offsets), F.col("_slice") == F.col("_of"))
            .select(*df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(out)))
