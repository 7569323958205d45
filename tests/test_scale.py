"""How queries scale: what is planned, written and moved for them, and that the short ways give the same rows."""

import os
import random
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lectern.functions.html_tree import to_markdown
from lectern.functions.markup import html_to_markdown
from lectern.operators import ordinal as numbering
from lectern.operators.hierarchy import block_table, build_hierarchy, store_hierarchy
from lectern.operators.problems import ParsedProblems
from lectern.operators.records import CourseRecords
from lectern.operators.validate import chapter_count_check
from lectern.session import checkpoint_dir

CARD = "01_One/01_Seq/01_Card"
FILES = [("index.yaml", "url_name: c\ndisplay_name: Course\n"), ("01_One/index.yaml", "url_name: one\n"),
         ("01_One/01_Seq/index.yaml", "url_name: seq\ndisplay_name: Seq\n"), (f"{CARD}/index.yaml", "url_name: card\n"),
         (f"{CARD}/00_a.md", "text"), (f"{CARD}/01_q.prob.md", ">>Q<<\n\n(x) yes {{L:: why}}\n( ) no\n\n|| hint ||\n"),
         (f"{CARD}/02_e.repl.yaml", '{"api_version":1,"environment":"python_3_4_free","src_path":"02_e.repl/src"}'),
         (f"{CARD}/02_e.repl/src/b/x.py", "two"), (f"{CARD}/02_e.repl/src/main.py", "one")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return sum("Exchange " in line and "Broadcast" not in line and "Reused" not in line for line in plan(df).split("== Initial Plan ==")[-1].splitlines())


@pytest.fixture
def course(spark):
    return spark.createDataFrame([("C", p, t) for p, t in FILES], "course_id string, path string, content string")


def stored(spark, files):
    base = f"{checkpoint_dir(spark)}/t-scale-{uuid.uuid4().hex}"
    return store_hierarchy(build_hierarchy(files), base, spark), base


def written(base) -> set:
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_tables_are_written_when_read(spark, course):
    """A query pays for the tables that it reads, not for all."""
    h, base = stored(spark, course)
    assert written(base) == set()
    assert h.courses.count() == 1 and written(base) == {"courses"}
    assert chapter_count_check(CourseRecords(h)).collect() == [("C", 1, 1)]
    assert written(base) == {"courses", "top_folders", "chapters"}
    assert [r.vert_id for r in h.verticals.collect()] == ["card"] and "blocks" not in written(base)


def test_times_are_rolled_up_when_read(spark, course):
    called = []
    r = CourseRecords(build_hierarchy(course), lambda: called.append(1))
    assert r.h.courses.count() == 1 and r.contents.count() == 1 and not called
    assert r.section_records.count() == 1 and called


def test_line_items_are_read_once(spark):
    from lectern.sources.catalogue import course_commits, course_files
    for rows in (course_files, course_commits):
        tree = rows(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert tree.count("l_linenumber#") and tree.count("Window") == 1


def test_lines_that_several_parts_match_keep_their_position(spark, tmp_path):
    """Repeated keys: positions count lines, not the rows that a join makes of them."""
    from lectern.sources.catalogue import _block_lines, table
    for name in ("nation", "customer", "orders"):
        table(spark, SF_SMALL, name).write.parquet(f"{tmp_path}/{name}.parquet")
    order = table(spark, SF_SMALL, "orders").first().o_orderkey
    li = table(spark, SF_SMALL, "lineitem").limit(1).withColumn("l_orderkey", F.lit(order).cast("bigint"))
    pick = lambda key: li.withColumn("l_partkey", F.lit(key).cast("bigint"))
    pick(1).unionByName(pick(1)).unionByName(pick(2)).unionByName(pick(3)).write.parquet(f"{tmp_path}/lineitem.parquet")
    part = table(spark, SF_SMALL, "part").limit(1)
    key = lambda k: part.withColumn("p_partkey", F.lit(k).cast("bigint"))
    key(1).unionByName(key(1)).unionByName(key(3)).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.l_partkey, r.nn) for r in _block_lines(spark, str(tmp_path)).collect())
    assert got == [(1, 0), (1, 0), (1, 1), (1, 1), (3, 3)]


def test_simple_documents_are_read_as_the_loader_reads_them():
    import json

    import yaml
    from lectern.sources.tree import _json_reader, _loader, _simple_document
    rng, read, fast = random.Random(5), _json_reader(), 0
    atoms = ["a", "Order 12", "Yes", "tRue", "null", "~", "1", "01", "1.5", "1e5", "http://a.b/c", "a: b", "a #b", "'q'", '"q"', "'q", "[]", "{}", "", " lead",
             "trail ", "0x1F", "1_000", "12:30", "2020-01-01", "=", "é", "- x", "a:", "off", "'a\\nb'", "&x", "*x", "|", "a\tb", "a  b", "\x85"]
    keys = ["url_name", "yes", "on", "x_1", "Null", "1a", "a b"]

    def value(depth=0):
        r = rng.random()
        if r < 0.5:
            return "".join(rng.choice("ab \"\\/\n\té:#,{}[]' \x85\x7f😀&*%-") for _ in range(rng.randrange(8)))
        if r < 0.7 or depth > 2:
            return rng.choice([1, -1, 0, 1.5, -0.0, 1e30, None, True, 10**25, float("nan")])
        return [value(depth + 1)] if r < 0.85 else {rng.choice(["a", "", "<<", "yes", "k" * 1100]): value(depth + 1)}

    for n in range(4000):
        text = ("\n".join(f"{rng.choice(keys)}:{rng.choice([' ', ''])}{rng.choice(atoms)}" for _ in range(rng.randrange(1, 4))) if n % 2
                else json.dumps({rng.choice(["a", "b c", "<<", "k" * 1100]): value() for _ in range(rng.randrange(3))}, ensure_ascii=rng.random() < 0.3))
        doc = _simple_document(text, read)
        if doc is not None:
            fast += 1
            assert json.dumps(doc) == json.dumps(yaml.load(text, Loader=_loader())), text
    assert fast > 800
    assert _simple_document("url_name: O1\ndisplay_name: Order 1\ngraded: true\n", read) == {"url_name": "O1", "display_name": "Order 1", "graded": True}


def test_ordinary_groups_are_numbered_without_a_checkpoint(spark, monkeypatch):
    """The sliced path is for groups that are too large for a task, and gives the same positions."""
    df = spark.range(3000).selectExpr("if(id % 3 = 0, null, id % 7) AS g", "id AS k", "uuid() AS wide").cache()
    want = {(r.g, r.k): r.pos for r in df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).collect()}
    sliced, calls = numbering._sliced, []
    monkeypatch.setattr(numbering, "_sliced", lambda *a: calls.append(1) or sliced(*a))
    assert {(r.g, r.k): r.pos for r in numbering.ordinal(df, ["g"], ["k"], "pos").collect()} == want and not calls
    monkeypatch.setattr(numbering, "HOT_ROWS", 500)
    monkeypatch.setattr(numbering, "HOT_PART", 10)
    assert {(r.g, r.k): r.pos for r in numbering.ordinal(df, ["g"], ["k"], "pos").collect()} == want and calls


@pytest.mark.parametrize("hot_rows", [1 << 20, 20])
def test_placed_rows_equal_a_join_with_their_positions(spark, monkeypatch, hot_rows):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(60), f"w{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "g string, k int, wide string").cache()
    monkeypatch.setattr(numbering, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(numbering, "HOT_PART", 100)
    positions = df.select("g", "k").withColumn("pos", (F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).cast("bigint"))
    want = sorted(map(tuple, df.join(positions, ["g", "k"]).select("g", "k", "wide", "pos").collect()))
    got = numbering.placed(df, ["g"], ["k"], "pos")
    assert sorted(map(tuple, got.select("g", "k", "wide", "pos").collect())) == want


def test_block_contents_move_once(spark, course):
    h, _ = stored(spark, course)
    assert exchanges(block_table(h.files, h.verticals)) <= 2  # the blocks and the verticals
    assert [(r.name, r.block_idx) for r in block_table(h.files, h.verticals).orderBy("block_idx").collect()] == [
        ("00_a.md", 0), ("01_q.prob.md", 1), ("02_e.repl.yaml", 2)]


def test_files_above_role_folders_do_not_move(spark, course):
    from lectern.operators.content import BLOCK_KEYS
    from lectern.operators.workspace import attach_files
    from lectern.sources.tree import with_path_parts
    roles = spark.createDataFrame([("C", "v", 0, "python_3_4_free", "src", f"{CARD}/02_e.repl/src"), ("C", "w", 0, "java_default_free", "src", f"{CARD}/02_e.repl/src/b")],
                                  "course_id string, vert_id string, block_idx int, environment string, role string, role_dir string")
    got = sorted((r.vert_id, r.path, r.is_dir, r.contents) for r in attach_files(roles, with_path_parts(course), BLOCK_KEYS).filter("not is_dir or vert_id = 'v'").collect())
    assert got == [("v", "b", True, None), ("v", "b/x.py", False, "two"), ("v", "main.py", False, "one"), ("w", "src/main/java/exlcode/x.py", False, "two")]
    assert exchanges(attach_files(roles, with_path_parts(course), BLOCK_KEYS).filter("not is_dir")) <= 2
    assert attach_files(roles.limit(0), with_path_parts(course), BLOCK_KEYS).count() == 0


def test_records_deal_elements_once(spark):
    docs = spark.createDataFrame([(1, FILES[5][1]), (2, "no question"), (3, "[x] a\n[ ] b\n\n---\n\n(x) c\n( ) d\n\n---\n\n>>L<<\n= 5\n")], "doc_id int, text string")
    p = ParsedProblems(docs, ["doc_id"], lambda name, df: spark.createDataFrame(df.collect(), df.schema))
    assert exchanges(p.records()) <= 6  # one of the elements; the runs of answers have some of their own
    got = {r.doc_id: (r.kind, r.label, r.demand_hint, r.choices and [(c.text, c.correct, c.hint) for c in r.choices]) for r in p.records().collect()}
    assert got == {1: ("multiplechoiceresponse", "Q", "hint", [("yes", True, "why"), ("no", False, "")]), 2: (None, "", None, None),
                   3: ("multiplechoiceresponse", "", None, [("c", True, ""), ("d", False, "")])}


def test_plain_lines_need_no_tag_tree(spark):
    texts = [" a b\t", "a &amp; b", "<b>x</b>", "a\n\n\n\nb", "x ", "```\n<b>\n```", "", None, "\r\n", "é  ü", "a``b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for keep in (False, True):
        got = [r[0] for r in df.select(html_to_markdown("t", keep_fences=keep)).collect()]
        assert got == [None if t is None else to_markdown(t, keep_fences=keep) for t in texts]


def test_only_files_that_can_be_named_are_joined(spark):
    """Code questions look for files with the endings that are named, not among all files."""
    more = [(f"{CARD}/03_c.prob.md", ">>W<<\n\n=#!exl::repl('03_c.prob.repl.yaml')\n"), (f"{CARD}/03_c.prob.repl.yaml", '{"src_path":"03_c.prob.repl/src"}'),
            (f"{CARD}/04_d.prob.md", ">>W<<\n\n=#!exl::repl('gone')\n")]
    files = spark.createDataFrame([("C", p, t) for p, t in FILES + more], "course_id string, path string, content string")
    r = CourseRecords(build_hierarchy(files))
    got = {x.repl_path: x.content for x in r.code_repls.collect()}
    assert got == {f"{CARD}/03_c.prob.repl.yaml": '{"src_path":"03_c.prob.repl/src"}', f"{CARD}/gone": None}
    assert ".prob.repl.yaml" in plan(r.code_repls)


def test_long_documents_are_passed_on_while_they_are_read(monkeypatch):
    """The rows of a long document leave in pieces, equal to those of one parse; one that breaks off
    late gives its error alone."""
    import pyarrow as pa
    from lectern.sources import xml
    good = '<v a="1">' + '<html k="&lt;">x<b/>y</html><p><!-- c --><q/></p>' * 40 + "</v>"
    texts = [good, good[:-3], "<a/>", None, "<a>"]
    batch = pa.RecordBatch.from_pydict({"course_id": pa.array(["C"] * 5), "path": pa.array([f"d/{i}.xml" for i in range(5)]), "content": pa.array(texts)})
    for name, value in (("WHOLE_BYTES", 50), ("PIECE", 7), ("ROWS_AT_A_TIME", 6)):
        monkeypatch.setattr(xml, name, value)
    out = list(xml._node_batches([batch]))
    assert len(out) > 20 and max(b.num_rows for b in out) < 12
    rows = [r for b in out for r in b.to_pylist()]
    made = lambda path: sorted(({k: dict(r[k]) if k == "attrs" else r[k] for k in xml._NODE} for r in rows if r["path"] == path and r["error"] is None), key=lambda r: r["node"])
    monkeypatch.setattr(xml, "PIECE", 1 << 20)
    assert made("d/0.xml") == xml.read_document(good) and made("d/2.xml") == xml.read_document("<a/>")
    assert [(r["path"], r["node"]) for r in rows if r["error"]] == [("d/1.xml", None), ("d/4.xml", None)]
    assert not made("d/1.xml") and not any(r["path"] == "d/3.xml" for r in rows)


def test_children_numbered_either_way_are_the_same(spark, monkeypatch):
    from lectern.operators import xml_import
    docs = {"course.xml": '<course url_name="c"/>', "course/c.xml": '<course><chapter url_name="a"/><chapter url_name="b"><sequential url_name="s"/>'
            '<sequential url_name="s"/></chapter></course>', "chapter/a.xml": '<chapter display_name="A"><x/><sequential url_name="t"><vertical url_name="v"><html url_name="h">i</html>'
            '<problem url_name="p"/></vertical></sequential><sequential url_name="u"/></chapter>', "html/h.xml": '<html display_name="H" filename="f"/>', "html/f.html": "<p>F</p>"}
    files = spark.createDataFrame([("C", p, t) for p, t in docs.items()], "course_id string, path string, content string")

    def found():
        x = xml_import.import_xml(files, lambda name, df: spark.createDataFrame(df.collect(), df.schema))
        return ([sorted(map(repr, df.drop("attrs").collect())) for df in (x.chapters, x.sequentials, x.verticals, x.blocks.select(
            "vert_id", "block_idx", "block_type", "url_name", "display_name", "html"))])

    once = found()
    assert [len(rows) for rows in once] == [2, 4, 1, 2] and "html='<p>F</p>'" in once[3][0]
    monkeypatch.setattr(xml_import, "hot_buckets", lambda df, keys: [0])
    assert found() == once


def test_appended_commits_are_kept_as_columns(spark, course, monkeypatch):
    """The touched files and folders of a batch are not checkpointed row by row."""
    import datetime as dt
    from lectern.operators.rollup_table import append_commits
    h = build_hierarchy(course)
    day = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("C", f"{CARD}/00_a.md", "c", day, day)], "course_id string, path string, commit_id string, author_ts timestamp_ntz, committer_ts timestamp_ntz")
    monkeypatch.setattr(type(log), "checkpoint", lambda *a, **b: pytest.fail("checkpointed"))
    rows = append_commits(spark, f"{checkpoint_dir(spark)}/t-append-{uuid.uuid4().hex}", h, log)
    assert sorted(r.folder for r in rows.collect()) == ["", "01_One", "01_One/01_Seq", CARD]
