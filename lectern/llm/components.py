"""Connected components of a distributed edge table, by alternating large-star and small-star steps.

Each step is a map-side combined minimum per vertex and one join on the vertex (whose one-row-per-
key side lets adaptive execution split a hot vertex). Every round is written to shared storage,
which cuts the lineage; the number of rounds is logarithmic in the number of vertices."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Edges are (a, b) with a > b.

    Large star: every neighbour greater than a vertex is linked to the vertex's least neighbour
    (itself included). Small star: every vertex's lesser neighbours, and itself, are linked to the
    least of them."""
    if large:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        links = both.where("u > v").join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        moved = edges.withColumnRenamed("a", "v").join(least, "v").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = moved.union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return links.where("a > b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` has long columns a, b. Returns (v, root): each vertex of a link and the least
    vertex of its component. Loops and repeated or two-way edges are fine. Rounds go on for as long
    as one changes the edges; every change lowers a vertex's least neighbour, so they end."""
    now = scratch("edges0", edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _sign(now)
    for k in count(1):
        now = scratch(f"edges{k}", _star(_star(now, True), False))
        sign = _sign(now)
        if sign == seen:
            break
        seen = sign
    # settled: every edge leads from a member to its root
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def _sign(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them (three numbers reach the driver)."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")).first()
    return r["n"], r["x"], r["y"]
