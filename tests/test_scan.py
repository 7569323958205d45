"""SRC-1 over real folders: what is listed, what is read, what becomes a row with an error."""

import os

import pytest
from pyspark.sql import functions as F

from lectern.operators.hierarchy import build_hierarchy
from lectern.operators.prefix import running_total
from lectern.operators.records import CourseRecords
from lectern.operators.validate import violations
from lectern.sinks.export import write_files
from lectern.sources import tree
from lectern.sources.tree import list_tree, read_files, scan_tree

TREE = {
    "C1/index.yaml": b"url_name: c1\n", "C1/1_A/index.yaml": b"display_name: A\n", "C1/1_A/1_B/1_C/00_a.md": "é".encode(),
    "C1/1_A/1_B/1_C/01_b.md": b"ab\xff", "C1/1_A/1_B/1_C/empty.md": b"", "C1/1_A/1_B/1_C/02_c.repl/src/__init__.py": b"1",
    "C1/1_A/1_B/1_C/02_c.repl/src/assets/kept.txt": b"deep", "C1/1_A/1_B/1_C/02_c.repl/src/pic.bin": b"\x00\xfe",
    "C1/assets/x.png": b"\x89PNG", "C1/.git/objects/ab": b"\xff", "C1/1_A/drafts/1/2.md": b"\xff", "C1/1_A/1_B/assets/p.png": b"\xff",
    ".git/HEAD": b"\xff", "stray.md": b"no course", "C2/index.yaml": b"\xff\xfe", "C2/_x/y.txt": b"underscore",
}
KEPT = {p for p in TREE if p.startswith("C") and "/drafts/" not in p and "C1/assets" not in p and ".git" not in p and "1_B/assets" not in p}


@pytest.fixture
def root(tmp_path):
    for path, content in TREE.items():
        os.makedirs(os.path.dirname(tmp_path / path) or tmp_path, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    return str(tmp_path)


def _path(r):
    return f"{r.course_id}/{r.path}"


def test_scan(spark, root):
    got = {_path(r): r for r in scan_tree(spark, root, partition_bytes=4).collect()}
    assert set(got) == KEPT
    for path in KEPT:
        r, raw = got[path], TREE[path]
        assert r.length == len(raw)
        try:
            assert (r.content, r.error) == (raw.decode(), None)
        except UnicodeDecodeError as exc:
            assert r.content is None and r.error == f"not UTF-8 text at byte {exc.start}"


def test_url_roots_and_empty(spark, root, tmp_path):
    whole = {_path(r) for r in scan_tree(spark, root).collect()}
    for spelled in (f"file://{root}", f"file:{root}", root + "/"):
        assert {_path(r) for r in list_tree(spark, spelled).collect()} == whole
    empty = tmp_path / "nothing"
    empty.mkdir()
    assert scan_tree(spark, str(empty)).count() == 0


def test_ignored_folders_are_never_listed_or_opened(spark, root):
    """Folders and files without permission would turn into error rows; ignored ones do not."""
    if os.geteuid() == 0:  # root reads everything: a dangling link fails to open instead
        os.symlink("/nowhere/at/all", os.path.join(root, "C1/assets/gone"))
    else:
        os.chmod(os.path.join(root, "C1/assets"), 0)
    errors = {r.error for r in scan_tree(spark, root).where("error is not null").collect()}
    assert errors == {"not UTF-8 text at byte 2", "not UTF-8 text at byte 1", "not UTF-8 text at byte 0"}


def test_vanished_file_is_a_row(spark, root):
    listed = list_tree(spark, root)
    os.remove(os.path.join(root, "C1/1_A/1_B/1_C/00_a.md"))
    got = {_path(r): r for r in read_files(spark, root, listed).collect()}
    assert got["C1/1_A/1_B/1_C/00_a.md"].error == "unreadable file: FileNotFoundError" and len(got) == len(KEPT)


def test_runs_of_equal_bytes(spark, tmp_path):
    rows = [(f"c{i % 3}", f"f{i:03}", "x" * (i % 7 * 10) + ("y" * 5000 if i == 40 else "")) for i in range(120)]
    assert write_files(spark.createDataFrame(rows, "course_id string, path string, content string"), str(tmp_path)) == 120
    files = scan_tree(spark, str(tmp_path), partition_bytes=600)
    sizes = [r[1] for r in files.groupBy(F.spark_partition_id()).agg(F.sum("length")).collect()]
    assert sum(sizes) == sum(len(r[2]) for r in rows) and sorted(sizes)[-2] <= 1300 and len(sizes) > 5
    assert {(r.course_id, r.path, r.content) for r in files.collect()} == set(rows)


def test_violations(spark, root):
    v = {(r.course_id, r.rule, r.path) for r in violations(CourseRecords(build_hierarchy(scan_tree(spark, root)))).collect()}
    assert ("C1", "VAL-13", "1_A/1_B/1_C/01_b.md") in v and ("C2", "VAL-13", "index.yaml") in v
    assert not any(p.endswith("pic.bin") for _, _, p in v)  # no block, no index


def test_running_total(spark):
    rows = [(i * 7919 % 1000, i % 13) for i in range(1000)]
    got = {r.k: r.start for r in running_total(spark.createDataFrame(rows, "k int, v int").repartition(5), ["k"], "v").collect()}
    total, want = 0, {}
    for k, v in sorted(rows):
        want[k], total = total, total + v
    assert got == want


def test_batches_of_content(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "READ_BATCH", 10)
    rows = [("c", f"f{i}", "z" * 9) for i in range(20)]
    write_files(spark.createDataFrame(rows, "course_id string, path string, content string"), str(tmp_path))
    assert {(r.course_id, r.path, r.content) for r in scan_tree(spark, str(tmp_path)).collect()} == set(rows)
