"""JOIN-6: presence by rows, and the digest tree against the full join."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import digest_tree
from lectern.operators.changes import changed_paths
from lectern.operators.digest_tree import changed_contents, changed_folders, changed_since, store_snapshot

SCHEMA = "course_id string, path string, content string"


def test_null_contents(spark):
    old = spark.createDataFrame([("a", None), ("b", "x"), ("c", None), ("d", None)], "path string, content string")
    new = spark.createDataFrame([("a", None), ("b", None), ("c", "y"), ("e", None)], "path string, content string")
    assert {tuple(r) for r in changed_paths(old, new).collect()} == {("b", "modified"), ("c", "modified"), ("d", "deleted"), ("e", "added")}


def _tree(rng, n):
    names = ["a", "b", "c.md", "d", "x y", "é"]
    rows = {}
    for _ in range(n):
        path = "/".join(rng.choice(names) for _ in range(rng.randrange(1, 6))) + f"/{rng.randrange(30)}.md" * rng.randrange(2)
        rows[(rng.choice(["C1", "C2"]), path + ".f")] = rng.choice([None, "", "one", "two"])
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_digest_tree_equals_full_join(spark, tmp_path, seed):
    rng = random.Random(seed)
    old = _tree(rng, 120)
    new = {k: (rng.choice([None, "", "three"]) if rng.random() < 0.1 else v) for k, v in old.items() if rng.random() > 0.1}
    if seed == 1:
        new |= _tree(rng, 10)
    if seed == 2:
        new = {}
    if seed == 3:
        new = dict(old)
    frames = [spark.createDataFrame([(*k, v) for k, v in rows.items()], SCHEMA) for rows in (old, new)]
    for name, frame in zip("on", frames):
        store_snapshot(frame, f"{tmp_path}/{name}", ["course_id"])
    got = {tuple(r) for r in changed_since(spark, f"{tmp_path}/o", f"{tmp_path}/n", f"{tmp_path}/w", ["course_id"]).collect()}
    assert got == {tuple(r) for r in changed_paths(*frames, ["course_id"]).collect()}
    back = {tuple(r) for r in changed_since(spark, f"{tmp_path}/n", f"{tmp_path}/o", f"{tmp_path}/w2", ["course_id"]).collect()}
    assert {(c, p, {"added": "deleted", "deleted": "added"}.get(s, s)) for c, p, s in got} == back
    contents = {(r.course_id, r.path): r.content for r in changed_contents(spark, f"{tmp_path}/o", f"{tmp_path}/n", f"{tmp_path}/w3", ["course_id"]).collect()}
    assert contents == {(c, p): new.get((c, p)) for c, p, _ in got}


def test_only_changed_folders_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digest_tree, "BUCKETS", 64)
    rows = [("C", f"{i % 40}_ch/{i % 80}_s/f{i}.md", f"text {i}") for i in range(800)]
    old = spark.createDataFrame(rows, SCHEMA)
    new = old.withColumn("content", F.when(F.col("path") == "7_ch/7_s/f7.md", "edited").otherwise(F.col("content")))
    for name, frame in (("o", old), ("n", new)):
        store_snapshot(frame, f"{tmp_path}/{name}", ["course_id"])
    folders = changed_folders(spark, f"{tmp_path}/o", f"{tmp_path}/n", f"{tmp_path}/w", ["course_id"])
    assert {r.folder for r in folders.collect()} == {"", "7_ch", "7_ch/7_s"}
    got = changed_since(spark, f"{tmp_path}/o", f"{tmp_path}/n", f"{tmp_path}/w", ["course_id"])
    assert [tuple(r) for r in got.collect()] == [("C", "7_ch/7_s/f7.md", "modified")]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "bucket#" in line]
    wanted = {r.bucket for r in folders.select("bucket").distinct().collect()}
    assert len(scans) >= 2 and all("PartitionFilters: [" in s and "bucket" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans)
    assert not any("content" in s.split("ReadSchema")[1] for s in scans) and len(wanted) <= 3


def test_empty_snapshots(spark, tmp_path):
    for name in "on":
        store_snapshot(spark.createDataFrame([], SCHEMA), f"{tmp_path}/{name}", ["course_id"])
    assert changed_since(spark, f"{tmp_path}/o", f"{tmp_path}/n", f"{tmp_path}/w", ["course_id"]).count() == 0
