"""AGG-1 / JOIN-5 / LIM-1: last-change times rolled up the hierarchy from a commit log.

Semantics:
* a file's time is the **author** time of its newest commit by **committer** time
  (ties broken by commit id);
* a vertical's time is the max over every file below the vertical's folder (the folder
  of its first block — blocks live directly in it), except files named ``index.yaml``;
  a vertical without blocks gets no time;
* sequential / chapter / course = max of their children; unset stays NULL.

Plan: one partial aggregation of the commit log per path (``max_by``), an equi-join to
the existing files on (course_id, path), one partial aggregation per vertical folder,
an equi-join to the verticals, then ROLLUP over the (small) per-vertical table — the
rollup never sees file- or commit-level rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.ids import keyed
from lectern.functions.paths import classify_block
from lectern.operators.hierarchy import Hierarchy

PATH = ["course_id", "path"]


def file_updated_at(commits: DataFrame) -> DataFrame:
    """Per (course_id, path): author time of the newest commit by committer time (with their ``_key``)."""
    return (keyed(commits, PATH).groupBy("_key", *PATH)
            .agg(F.max_by("author_ts", F.struct("committer_ts", "commit_id")).alias("file_updated_at")))


def vertical_updated_at(h: Hierarchy, commits: DataFrame) -> DataFrame:
    """JOIN-5: verticals with ``updated_at`` (NULL when unset)."""
    f = keyed(h.files.filter(F.col("depth") >= 3).select(*PATH, "depth", "name"), PATH)
    per_file = f.join(file_updated_at(commits), ["_key", *PATH], "left")
    is_block = (F.col("depth") == 3) & classify_block(F.col("name")).isNotNull()
    per_vfolder = (per_file
                   .groupBy("course_id", F.substring_index("path", "/", 3).alias("folder"))
                   .agg(F.max(F.when(F.col("name") != "index.yaml", F.col("file_updated_at"))).alias("ts"),
                        F.max(is_block).alias("has_block")))
    return (h.verticals.join(per_vfolder, ["course_id", "folder"], "left")
            .withColumn("updated_at", F.when(F.col("has_block"), F.col("ts")))
            .drop("ts", "has_block"))


def rollup_updated_at(h: Hierarchy, commits: DataFrame, stage=None) -> dict[str, DataFrame]:
    """AGG-1: ``{"vertical", "sequential", "chapter", "course"}`` → node rows with ``updated_at``.

    ``stage(name, df)`` may persist the per-vertical table, which all four outputs read."""
    v = (stage or (lambda name, df: df))("vertical_updated_at", vertical_updated_at(h, commits))
    r = (v.rollup("course_id", "chapter_id", "seq_id")
         .agg(F.max("updated_at").alias("updated_at"), F.grouping_id().alias("gid")))
    seq_t = r.filter(F.col("gid") == 0).select("course_id", "seq_id", "updated_at")
    chap_t = r.filter(F.col("gid") == 1).select("course_id", "chapter_id", "updated_at")
    course_t = r.filter(F.col("gid") == 3).select("course_id", "updated_at")
    return {
        "vertical": v,
        "sequential": h.sequentials.join(seq_t, ["course_id", "seq_id"], "left"),
        "chapter": h.chapters.join(chap_t, ["course_id", "chapter_id"], "left"),
        "course": h.courses.join(course_t, ["course_id"], "left"),
    }
