"""Position of rows within their group (``row_number() - 1``) that survives hot groups.

A window partitioned by the group sorts each group inside one task; a group holding a
third of all rows would be one straggler task. So the rows are counted first, by a hash of their group
in ``BUCKETS`` buckets (one number a bucket and task): no group is larger than its bucket. Groups of
buckets with at most ``HOT_ROWS`` rows, or one part in ``HOT_PART`` of all rows, take the window. The
others are range-partitioned on (group, order): the range sampler splits a large group over several
tasks. The split is checkpointed, so that it stays the same when tasks run again. Each slice numbers its
rows of a group locally; a group that runs on from earlier slices adds their row counts. Only a group that
crosses a slice boundary does, so the broadcast list of those counts has fewer rows than there
are shuffle partitions.

The order columns must order a group totally (e.g. a file name within its folder). Pass narrow
rows to ``ordinal``; ``placed`` takes wide ones, of which only hot groups move twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
HOT_ROWS = 1 << 20
HOT_PART = 1 << 12


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def hot_buckets(df: DataFrame, keys: list[str]) -> list[int]:
    """The buckets that hold groups too large for one task, fewer than ``HOT_PART``."""
    counts = df.groupBy(_bucket(keys).alias("_bucket")).agg(F.count("*").alias("_n"))
    rows, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(HOT_ROWS, (rows or 0) // HOT_PART)
    return [r["_bucket"] for r in counts.filter(F.col("_n") > limit).collect()] if (most or 0) > limit else []


def _divided(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary groups, and those of hot ones if there are any."""
    hot = hot_buckets(df, keys)
    if not hot:
        return df, None
    return df.filter(~_bucket(keys).isin(hot)), df.filter(_bucket(keys).isin(hot))


def ordinal(df: DataFrame, keys: list[str], order: list[str], out: str = "idx") -> DataFrame:
    cold, hot = _divided(df, keys)
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order])) - 1
    numbered = cold.withColumn(out, position.cast("bigint"))
    return numbered if hot is None else numbered.unionByName(_sliced(hot, keys, order, out))


def placed(df: DataFrame, keys: list[str], order: list[str], out: str = "idx") -> DataFrame:
    """Wide rows with their position, as a join with the ``ordinal`` of their keys and order gives
    them: rows that are equal in both have all positions of theirs each; rows with a null there go."""
    df = df.dropna(subset=[*keys, *order])
    cold, hot = _divided(df, keys)
    siblings = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order])
    equal = F.count("*").over(siblings.rangeBetween(Window.currentRow, Window.currentRow))
    cold = (cold.withColumns({"_first": F.rank().over(siblings), "_equal": equal})
            .withColumn(out, F.explode(F.sequence(F.col("_first").cast("bigint") - 1, F.col("_first") + F.col("_equal") - 2)))
            .drop("_first", "_equal"))
    if hot is None:
        return cold
    numbered = _sliced(hot.select(*keys, *order), keys, order, out)
    return cold.unionByName(hot.join(numbered, [*keys, *order]).select(*cold.columns))


def _sliced(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Narrow rows numbered over range slices; they are written once to the checkpoint folder."""
    from lectern.session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = (df.repartitionByRange(n, *[F.col(c) for c in keys + order])
              .withColumn("_slice", F.spark_partition_id()).checkpoint(eager=True))
    local = F.row_number().over(Window.partitionBy("_slice", *keys).orderBy(*[F.col(c) for c in order])) - 1
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (sliced.groupBy("_slice", *keys).agg(F.count("*").alias("_n")).withColumn("_off", earlier)
               .filter(F.col("_off") > 0).select(*[F.col(k).alias(f"_k_{k}") for k in ["_slice", *keys]], "_off"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in ["_slice", *keys]])
    return (sliced.withColumn("_local", local).join(F.broadcast(offsets), same, "left")
            .select(*df.columns, (F.col("_local") + F.coalesce("_off", F.lit(0))).cast("bigint").alias(out)))
