"""JOIN-6 on stored snapshots: a digest per folder, so that comparing descends only where something changed.

A snapshot is written once: ``files`` (path, digest of the content, content) in buckets of the folder,
and ``folders`` by depth, each folder with a digest over its files and the digests of its folders.
Folders are digested bottom-up, level by level, from sums over their children (count, and the four
words of each child's SHA-256 added up as exact decimals): partial sums combine on the map side, so
a folder with very many files is no single task's work and no order is needed.

``changed_since`` walks two snapshots from the root down: at each depth only folders below a
changed parent are compared, and their digests read; files are read only in the buckets of
changed folders, and of these only path and digest. Contents are read for changed paths alone
(``changed_contents``). A null content is a content of its own: a path is there or not by its row.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of folders in a snapshot's files. The list of buckets that changed is at most this long.
BUCKETS = 256
_SUMS = ["n", "s0", "s1", "s2", "s3"]


def _folder(path: Column) -> Column:
    """The folder of a path; the root is the empty text."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _depth(folder: Column) -> Column:
    return F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))


def _bucket(keys: list[str], folder: str = "folder") -> Column:
    return F.pmod(F.xxhash64(*keys, folder), F.lit(BUCKETS)).cast("int")


def _sums(kind: str, path: Column, digest: Column) -> list[Column]:
    """What a child adds to its folder: 1 and the words of a hash over its kind, name and digest."""
    h = F.sha2(F.concat_ws("\n", F.lit(kind), F.substring_index(path, "/", -1), digest), 256)
    words = [F.conv(F.substring(h, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    return [F.count("*").alias("n"), *[F.sum(w).cast("decimal(38,0)").alias(f"s{i}") for i, w in enumerate(words)]]


def store_snapshot(files: DataFrame, base: str, keys: list[str] | None = None) -> None:
    """Write ``files`` (keys, path, content; one row a path) as a snapshot below ``base``."""
    keys, spark = keys or [], files.sparkSession
    digest = F.coalesce(F.sha2("content", 256), F.lit("none"))
    rows = files.select(*keys, "path", digest.alias("digest"), "content").withColumn("folder", _folder(F.col("path"))).withColumn("bucket", _bucket(keys))
    rows.repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/files")
    stored = spark.read.schema(rows.schema).parquet(f"{base}/files")
    own = stored.groupBy(*keys, "folder").agg(*_sums("file", F.col("path"), F.col("digest"))).withColumn("depth", _depth(F.col("folder")))
    own.write.mode("overwrite").parquet(f"{base}/own")
    own = spark.read.parquet(f"{base}/own")
    below, deepest = None, own.agg(F.max("depth")).first()[0]
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        parts = own.filter(F.col("depth") == depth).select(*keys, "folder", *_SUMS)
        if below is not None:
            up = below.groupBy(*keys, F.col("parent").alias("folder")).agg(*_sums("folder", F.col("folder"), F.col("digest")))
            parts = parts.unionByName(up).groupBy(*keys, "folder").agg(*[F.sum(s).alias(s) for s in _SUMS])
        level = parts.select(*keys, "folder", _folder(F.col("folder")).alias("parent"), F.sha2(F.concat_ws(":", *_SUMS), 256).alias("digest"))
        level.write.mode("overwrite").parquet(f"{base}/folders/depth={depth}")
        below = spark.read.parquet(f"{base}/folders/depth={depth}")


def _files(spark: SparkSession, base: str) -> DataFrame:
    """The files of a snapshot (an empty one has no part to tell its columns)."""
    keys = [f for f in spark.read.parquet(f"{base}/own").schema.fields if f.name not in ("folder", "depth", *_SUMS)]
    fixed = [T.StructField(c, T.StringType()) for c in ("path", "digest", "content", "folder")] + [T.StructField("bucket", T.IntegerType())]
    return spark.read.schema(T.StructType(keys + fixed)).parquet(f"{base}/files")


def _depths(spark: SparkSession, base: str) -> int:
    """How many levels of folders a snapshot has (0: it is empty)."""
    deepest = spark.read.parquet(f"{base}/own").agg(F.max("depth")).first()[0]
    return 0 if deepest is None else deepest + 1


def _outer(old: DataFrame | None, new: DataFrame | None, on: list[str]) -> DataFrame:
    """Full outer join on ``on`` of the sides' digests, with ``_old`` and ``_new`` where a side has the row."""
    if old is None or new is None:
        side, there, missing = (new, "new", "old") if old is None else (old, "old", "new")
        return side.select(*on, F.col("digest").alias(f"{there}_digest"), F.lit(True).alias(f"_{there}"),
                           F.lit(None).cast("string").alias(f"{missing}_digest"), F.lit(None).cast("boolean").alias(f"_{missing}"))
    sides = [df.select(*on, F.col("digest").alias(f"{name}_digest"), F.lit(True).alias(f"_{name}")) for df, name in ((old, "old"), (new, "new"))]
    return sides[0].join(sides[1], on, "full_outer")


def _differs() -> Column:
    return F.col("_old").isNull() | F.col("_new").isNull() | ~F.col("old_digest").eqNullSafe(F.col("new_digest"))


def changed_folders(spark: SparkSession, old: str, new: str, base: str, keys: list[str] | None = None) -> DataFrame | None:
    """(keys, folder, bucket) of the folders whose digests differ, written level by level to a new
    folder below ``base``; None if the snapshots are equal."""
    keys, base = keys or [], f"{base}/{uuid.uuid4().hex}"
    levels, changed, depths = [], None, {side: _depths(spark, side) for side in (old, new)}
    for depth in range(max(depths.values())):
        sides = []
        for side in (old, new):
            level = spark.read.parquet(f"{side}/folders/depth={depth}") if depth < depths[side] else None
            if level is not None and changed is not None:
                level = level.join(changed.select(*keys, F.col("folder").alias("parent")), [*keys, "parent"], "left_semi")
            sides.append(level)
        _outer(*sides, [*keys, "folder"]).filter(_differs()).select(*keys, "folder").write.mode("overwrite").parquet(f"{base}/depth{depth}")
        changed = spark.read.parquet(f"{base}/depth{depth}")
        if changed.isEmpty():
            break
        levels.append(changed)
    return reduce(DataFrame.unionByName, levels).withColumn("bucket", _bucket(keys)) if levels else None


def _files_of(spark: SparkSession, side: str, folders: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A snapshot's files in ``folders``: only their buckets are scanned."""
    buckets = [r["bucket"] for r in folders.select("bucket").distinct().collect()]  # at most BUCKETS
    return (_files(spark, side).filter(F.col("bucket").isin(buckets)).select(*keys, "folder", "path", *columns)
            .join(folders.select(*keys, "folder"), [*keys, "folder"], "left_semi"))


def _changed_paths(spark: SparkSession, old: str, new: str, folders: DataFrame | None, keys: list[str]) -> DataFrame:
    if folders is None:
        return _files(spark, new).limit(0).select(*keys, "path", F.lit("").alias("status"))
    sides = [_files_of(spark, side, folders, keys, ["digest"]) for side in (old, new)]
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("modified")
    return _outer(*sides, [*keys, "path"]).filter(_differs()).select(*keys, "path", status.alias("status"))


def changed_since(spark: SparkSession, old: str, new: str, base: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, path, status) between the snapshots below ``old`` and ``new``; ``base``: a folder for the
    levels compared. The same rows as ``changes.changed_paths`` on the whole tables."""
    return _changed_paths(spark, old, new, changed_folders(spark, old, new, base, keys), keys or [])


def changed_contents(spark: SparkSession, old: str, new: str, base: str, keys: list[str] | None = None) -> DataFrame:
    """``changed_since`` with the new content of each added or modified path."""
    keys = keys or []
    folders = changed_folders(spark, old, new, base, keys)
    changed = _changed_paths(spark, old, new, folders, keys)
    if folders is None:
        return changed.withColumn("content", F.lit(None).cast("string"))
    now = _files_of(spark, new, folders, keys, ["content"]).select(*keys, "path", "content")
    return changed.join(now, [*keys, "path"], "left")
