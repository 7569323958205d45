"""Golden fixtures: a hand-made catalogue covering the tricky cases of the folder layout."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lectern.operators.hierarchy import build_hierarchy, store_hierarchy
from lectern.operators.records import CourseRecords
from lectern.operators.timestamps import rollup_updated_at
from lectern.operators.validate import violations
from lectern.sources.tree import scan_tree

QUIZ = ">>Pick one||desc<<\n\n(x) right {{Good:: because}}\n( ) wrong\n\n|| think ||\n"
CODE = ">>Write it<<\n\n=#!exl::repl('03_code.prob.repl.yaml')\n"
REPL = json.dumps({"api_version": 1, "environment": "python_3_4_free", "src_path": "02_run.repl/src"})

FILES = {
    ("C1", "index.yaml"): "url_name: c1\ndisplay_name: Course One\ntopics: []\nskill_level: ''\n"
                          "repo_url: https://gitlab.com/x/c1\nweight: 3\n",
    ("C1", "assets/img.png"): "binary",
    ("C1", "10_Late/index.yaml"): "url_name: ch10\ndisplay_name: Late\n",
    ("C1", "2_Early/index.yml"): "url_name: ch2\ndisplay_name: Early\n",
    ("C1", "2_Early/1_Sec/index.yaml"): "url_name: s1\ndisplay_name: Sec\n",
    ("C1", "2_Early/2_Exam/index.yaml"): "url_name: s2\ndisplay_name: Exam\ngraded: true\nformat: Final Exam\n",
    ("C1", "2_Early/3_Sec3/index.yaml"): "url_name: s3\ndisplay_name: ''\n",
    ("C1", "2_Early/1_Sec/1_Card/index.yaml"): "url_name: v1\ndisplay_name: Card\n",
    ("C1", "2_Early/1_Sec/1_Card/00_text.md"): "Hello *world*",
    ("C1", "2_Early/1_Sec/1_Card/01_quiz.prob.md"): QUIZ,
    ("C1", "2_Early/1_Sec/1_Card/02_run.repl.yaml"): REPL,
    ("C1", "2_Early/1_Sec/1_Card/02_run.repl/src/main.py"): "print(1)",
    ("C1", "2_Early/1_Sec/1_Card/03_code.prob.md"): CODE,
    ("C1", "2_Early/1_Sec/2_Empty/index.yaml"): "url_name: v2\ndisplay_name: Empty\n",
    ("C1", "2_Early/2_Exam/1_Q/index.yaml"): "url_name: v3\ndisplay_name: Q\n",
    ("C1", "2_Early/2_Exam/1_Q/00_q.prob.md"): QUIZ,
    ("C1", "2_Early/2_Exam/2_Q2/index.yaml"): "url_name: v4\ndisplay_name: Q2\n",
    ("C1", "2_Early/2_Exam/2_Q2/00_a.prob.md"): QUIZ,
    ("C1", "2_Early/2_Exam/2_Q2/01_b.md"): "text",
    ("C1", "2_Early/3_Sec3/1_C/00_a.md"): "no index here",
    ("C1", "2_Early/x.repl/inner/00_a.md"): "ignored",
    ("C2", "index.yaml"): "url_name: c2\ndisplay_name: Empty course\n",
}

T = dt.datetime
COMMITS = [
    ("C1", "2_Early/1_Sec/1_Card/00_text.md", "c1", T(2020, 1, 5), T(2020, 1, 10)),
    ("C1", "2_Early/1_Sec/1_Card/00_text.md", "c2", T(2020, 1, 1), T(2020, 1, 20)),
    ("C1", "2_Early/1_Sec/1_Card/01_quiz.prob.md", "c3", T(2019, 12, 31), T(2019, 12, 31)),
    ("C1", "2_Early/1_Sec/1_Card/index.yaml", "c4", T(2021, 1, 1), T(2021, 1, 1)),
    ("C1", "2_Early/1_Sec/2_Empty/index.yaml", "c5", T(2021, 1, 1), T(2021, 1, 1)),
]


@pytest.fixture(scope="module")
def golden(spark):
    files = spark.createDataFrame([(c, p, t) for (c, p), t in FILES.items()], "course_id string, path string, content string")
    commits = spark.createDataFrame(COMMITS, "course_id string, path string, commit_id string, author_ts timestamp_ntz, "
                                             "committer_ts timestamp_ntz")
    h = store_hierarchy(build_hierarchy(files), tempfile.mkdtemp(prefix="lectern-golden-"), spark)
    return files, h, commits, CourseRecords(h, rollup_updated_at(h, commits))


def test_sibling_order_is_byte_order(golden):
    _, h, _, _ = golden
    ch = {r.chapter_id: (r.idx, r.display_name) for r in h.chapters.collect()}
    assert ch == {"ch10": (0, "Late"), "ch2": (1, "Early")}


def test_index_rules(golden):
    _, h, _, _ = golden
    seq = {r.seq_id: r.display_name for r in h.sequentials.collect()}
    assert seq == {"s1": "Sec", "s2": "Exam", "s3": ""}          # empty display name wins over folder name
    v = {r.display_name: r.vert_id for r in h.verticals.collect()}
    assert len(v["C"]) == 32 and v["C"].isalpha()                # no index: folder name + derived id
    wb = h.id_writeback.collect()
    assert [(r.folder, r.url_name) for r in wb] == [("2_Early/3_Sec3/1_C", v["C"])]


def test_blocks_and_ignored_folders(golden):
    _, h, _, _ = golden
    b = sorted((r.vert_id, r.block_idx, r.block_type) for r in h.blocks.collect() if r.vert_id == "v1")
    assert b == [("v1", 0, "html"), ("v1", 1, "problem"), ("v1", 2, "exleditor"), ("v1", 3, "problem")]
    assert not any("x.repl" in r.folder for r in h.blocks.collect())


def test_rollup(golden):
    _, h, commits, _ = golden
    r = rollup_updated_at(h, commits)
    v = {x.vert_id: x.updated_at for x in r["vertical"].collect()}
    assert v["v1"] == T(2020, 1, 1)      # newest by committer time has the older author time
    assert v["v2"] is None               # no block: no time even with a committed index
    assert {x.seq_id: x.updated_at for x in r["sequential"].collect()}["s1"] == T(2020, 1, 1)
    assert {x.course_id: x.updated_at for x in r["course"].collect()} == {"C1": T(2020, 1, 1), "C2": None}


def test_records(golden):
    _, _, _, rec = golden
    secs = {r["id"]: r["index"] for r in rec.section_records.collect()}
    assert secs == {"s1": 1, "s3": 3}    # exam section leaves a gap
    units = {r.id: list(r.final_exam_ids) for r in rec.unit_records.collect()}
    assert units == {"ch10": [], "ch2": ["s2_exam"]}
    cards = {r.id: (list(r.question_ids), r.github_edit_url) for r in rec.card_records.collect()}
    assert cards["v1"] == (["v1_q_0", "v1_q_1"], "")          # other host: no edit URL
    c = rec.course_records.collect()
    assert {r.course_id: list(r.topics) for r in c}["C1"] == [""]
    ex = {r.id: (r.question_count, r.est_time, r.time_limit) for r in rec.exams.collect()}
    assert ex == {"s2_exam": (1, 1, 2)}
    content = {r.vert_id: r.content for r in rec.contents.collect()}
    assert content["v1"].startswith("Hello *world*\n\n<iframe src=\"https://exlcode.com/repl?embedded=true&amp;workspace=")


def test_violations(golden):
    _, _, _, rec = golden
    v = {(r.rule, r.path) for r in violations(rec).collect()}
    assert ("VAL-8", "2_Early/2_Exam/2_Q2") in v
    assert any(rule == "VAL-6" and p.endswith("03_code.prob.md") for rule, p in v)


def test_scan_tree_matches_table(spark, tmp_path, golden):
    files, _, _, _ = golden
    for (c, p), text in FILES.items():
        full = os.path.join(tmp_path, c, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as fh:
            fh.write(text)
    scanned = scan_tree(spark, str(tmp_path))
    got = {(r.course_id, r.path, r.content) for r in scanned.collect()}
    assert got == {(c, p, t) for (c, p), t in FILES.items() if not p.startswith("assets/")}
    h = build_hierarchy(scanned)
    assert h.verticals.count() == build_hierarchy(files).verticals.count()


def test_load_skips_only_invalid_courses(spark, golden):
    from lectern.plans.jobs import load
    from lectern.sinks.upsert import read_table
    _, h, commits, _ = golden
    base = tempfile.mkdtemp(prefix="lectern-load-")
    report = {r.course_id: (r.n_errors > 0, r.loaded) for r in load(spark, h, commits, base).collect()}
    assert report == {"C1": (True, False), "C2": (False, True)}
    courses = read_table(spark, f"{base}/course")
    assert [r.url_name for r in courses.collect()] == ["c2"]
    assert courses.filter(F.col("updated_at").isNull()).count() == 0


CODE_PROBLEM = """>>Which `a||b`?||d<<

(x) use <b>bold</b> and `x < y | z` {{Yes:: `p|q` <i>it</i>}}
( ) no

+( ) ```
|| not a hint ||
if a<b && c>>2:
``` -( )-

|| real `h|i` hint ||
"""


def test_code_is_not_markup(spark):
    """Forms inside code are text; choices become Markdown with their code restored."""
    from lectern.operators.problems import ParsedProblems, question_choices
    p = ParsedProblems(spark.createDataFrame([(1, CODE_PROBLEM)], "doc_id int, text string"), ["doc_id"])
    assert [(r.label, r.description) for r in p.labels.collect()] == [("Which `a||b`?", "d")]
    assert [r.hint for r in p.hints.collect()] == ["real `h|i` hint"]
    rows = sorted(question_choices(p.records(), ["doc_id"]).collect(), key=lambda r: r.seq)
    assert [(r.text, r.is_answer, r.explanation) for r in rows] == [
        ("use **bold** and `x < y | z`", True, "`p|q` *it*"), ("no", False, ""),
        ("```\n|| not a hint ||\nif a<b && c>>2:\n```", False, "")]


def test_edits_take_effect_in_order(spark):
    """A removed folder refuses later edits below it; a removed file can be written again."""
    from lectern.operators.workspace import apply_file_edits
    ws = spark.createDataFrame(
        [("w", p, p.split("/")[-1], d, False, imm, False, c) for p, d, imm, c in [
            ("a", True, False, None), ("a/b", True, False, None), ("a/b/x", False, False, "x"), ("a/y", False, False, "y"),
            ("z", False, True, "z"), ("k", True, False, None)]],
        "ws string, path string, name string, is_dir boolean, is_tmpl boolean, is_immutable boolean, is_hidden boolean, "
        "contents string")
    log = [("write", "a/b/new", "n"), ("remove", "a/b", None), ("write", "a/b/late", "l"), ("remove", "a/b/x", None),
           ("remove", "a/y", None), ("remove", "a/y", None), ("write", "a/y", "again"), ("write", "z", "no"),
           ("write", "k", "dir"), ("write", "top", "t"), ("remove", "a/b", None), ("write", "a/b", "file now")]
    edits = spark.createDataFrame([("w", i, *e) for i, e in enumerate(log)],
                                  "ws string, seq int, op string, path string, contents string")
    after, out = apply_file_edits(ws, edits, ["ws"])
    assert [r.status for r in sorted(out.collect(), key=lambda r: r.seq)] == [
        "applied", "applied", "refused: parent is not a folder", "refused: no such file", "applied", "refused: no such file",
        "applied", "refused: protected file", "refused: target is a folder", "applied", "refused: no such file", "applied"]
    assert {r.path: r.contents for r in after.collect()} == {
        "a": None, "a/b": "file now", "a/y": "again", "z": "z", "k": None, "top": "t"}


def test_shared_sources_above_the_card(spark):
    """A repl may name a source folder elsewhere in the course (``..`` is resolved)."""
    from lectern.operators.workspace import attach_files, repl_roles
    from lectern.sources.tree import with_path_parts
    repl = spark.sql("""SELECT 'C' AS course_id, 'v' AS vert_id, 0 AS block_idx, '01_a/01_b/01_c' AS folder, struct(
        'java_default_free' AS environment, '../../common/src' AS src_path, '' AS tmpl_path, '' AS test_path) AS repl""")
    files = with_path_parts(spark.createDataFrame(
        [("C", "01_a/common/src/p/A.java", "class A"), ("C", "01_a/common/other", "no")],
        "course_id string, path string, content string"))
    keys = ["course_id", "vert_id", "block_idx"]
    got = {r.path: (r.is_dir, r.is_tmpl, r.contents) for r in attach_files(repl_roles(repl, keys), files, keys).collect()}
    assert got["src/main/java/exlcode/p/A.java"] == (False, False, "class A")
    assert got["src/main/java/exlcode"] == (True, True, None) and got["src/main/java/exlcode/p"] == (True, False, None)
    assert len(got) == 6


def test_row_difference_counts_copies(spark):
    from lectern.operators.changes import changed_rows
    old = spark.createDataFrame([("p", "a"), ("q", None), ("r", "c")], "path string, content string")
    new = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "a"), ("q", "")], "path string, content string")
    got = sorted((r.side, r.path, r.content) for r in changed_rows(old, new).fillna("NULL").collect())
    assert got == [("new", "p", "a"), ("new", "p", "a"), ("new", "q", ""), ("old", "q", "NULL"), ("old", "r", "c")]
