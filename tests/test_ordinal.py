"""Hot-group numbering equals the plain window numbering."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lectern.operators.ordinal import ordinal
from lectern.sources.catalogue import table


def test_hot_path_equals_window(spark):
    li = table(spark, SF_SMALL, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                   "l_quantity", "l_shipdate")
    # make one order hold a third of the rows: a hot group
    df = li.withColumn("g", F.when(F.col("l_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.col("l_orderkey")))
    df = df.withColumn("k", F.monotonically_increasing_id())
    order = ["l_partkey", "l_suppkey", "l_linenumber", "k"]
    got = ordinal(df, ["g"], order, "pos")
    w = Window.partitionBy("g").orderBy(*order)
    want = df.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))
    a = sorted((r.g, r.k, r.pos) for r in got.select("g", "k", "pos").collect())
    b = sorted((r.g, r.k, r.pos) for r in want.select("g", "k", "pos").collect())
    assert a == b
    assert df.filter("g = -1").count() > 50
