"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group. Groups, largest first, go to the shard where the dot
product of the group's size vector (shares of all bytes, tokens and rows) with the shard's residual
capacity is highest, among the shards whose bytes still take it; if none does, to the one with most
bytes left.

At scale: sizes are computed in one pass and staged as narrow rows; groups are summed map-side
first. Groups below 1/(UNITS_A_SHARD x shards) of the whole in every dimension are bundled by hash,
so what is placed is at most 7 x UNITS_A_SHARD x shards units however large the input (one bundle a
hash value, at most 3 x UNITS_A_SHARD x shards larger groups, and their pieces): a proven bound for
the table that reaches the driver and comes back as a broadcast. A group larger than a shard's
capacity in some dimension cannot stay whole under near-equal sizes; it is dealt in pieces of at
most a quarter of a shard. Slots are counted per slice of a shard and offset, so no shard meets in
one task.

Cases: null text → no bytes, no tokens, crc32 0, grouped apart from the empty text; null and
repeated ids are rows like any other; empty table → empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Scratch

UNITS_A_SHARD = 256
PIECES_A_SHARD = 4
#: Rows that one task numbers at a time.
SLICE_ROWS = 50_000
DIMENSIONS = ("bytes", "tokens", "rows")


def place(units: list[tuple[float, ...]], shards: int) -> list[int]:
    """The shard of each unit (shares of the whole in each dimension), by dot product."""
    size = np.array(units, dtype=float).reshape(-1, len(DIMENSIONS))
    left = np.full((shards, len(DIMENSIONS)), 1.0 / shards)
    out = [0] * len(size)
    for u in np.argsort(-size.max(axis=1), kind="stable").tolist() if len(size) else []:
        fit = left[:, 0] >= size[u, 0] - 1e-12
        s = int(np.argmax(np.where(fit, left @ size[u], -np.inf))) if fit.any() else int(np.argmax(left[:, 0]))
        left[s] -= size[u]
        out[u] = s
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc, tokens and the group's digest of every row."""
    text = F.col("text").cast("string")
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return docs.select(F.col("doc_id").cast("long"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                       F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
                       F.coalesce(F.md5(raw), F.lit("")).alias("digest"), text.isNull().alias("none"))


def assign(docs: DataFrame, shards: int, *, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sharding")
    rows = scratch("rows", sized(docs).withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    whole = [float(max(1, total[d] or 0)) for d in DIMENSIONS]
    shares = lambda: [F.sum("size") / whole[0], F.sum("tokens") / whole[1], F.count("*") / whole[2]]
    # at most 3 x UNITS_A_SHARD x shards groups can be this large, whatever the input
    large = rows.groupBy("digest", "none").agg(F.greatest(*shares()).alias("share")).where(F.col("share") >= 1.0 / (UNITS_A_SHARD * shards))
    large = scratch("large", large.withColumn("pieces", F.when(F.col("share") > 1.0 / shards, F.ceil(F.col("share") * shards * PIECES_A_SHARD)).otherwise(1).cast("int")))
    unit = F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), F.pmod(F.xxhash64("digest", "none"), F.lit(UNITS_A_SHARD * shards)))).otherwise(
        F.concat_ws(":", "digest", "none", F.pmod(F.xxhash64("row"), F.col("pieces"))))
    in_units = rows.join(F.broadcast(large), ["digest", "none"], "left").withColumn("unit", unit)
    units = sorted(((r["unit"], (r["bytes"], r["tokens"], r["n"])) for r in in_units.groupBy("unit").agg(*[c.alias(n) for c, n in zip(shares(), ("bytes", "tokens", "n"))]).collect()))
    placed = spark.createDataFrame([(u, s) for (u, _), s in zip(units, place([v for _, v in units], shards))], "unit string, shard int")
    sliced = in_units.join(F.broadcast(placed), "unit").withColumn("slice", F.pmod(F.xxhash64("row", F.lit("slice")), F.lit(max(1, total["rows"] // (shards * SLICE_ROWS)))))
    sliced = scratch("placed", sliced.select("doc_id", "size", "text_crc32", "shard", "slice", "row"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("shard", "slice").agg(F.count("*").alias("n")).select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("row"))
    return sliced.withColumn("k", inside).join(offsets, ["shard", "slice"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("k") - 1).cast("long").alias("slot"))
