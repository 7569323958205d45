"""Stand-in course catalogues built from the driver's tables.

Each function only lays rows out in the schema the engine reads (``files``, ``commits``,
``push_events``, problem documents, workspace files, …). None of them numbers, parses,
resolves or aggregates anything: that is the library's work, done on these rows exactly
as on a scanned catalogue.

Mapping (one course tree per region):

* course     region   ``R<key>``; root ``index.yaml``
* chapter    nation   folder ``<n_nationkey>_<n_name>`` (no zero padding)
* sequential customer folder ``<c_custkey>_<c_name>``; graded = HOUSEHOLD segment;
                      format ``Final Exam`` for even keys else ``Homework``
* vertical   orders   folder ``<o_orderkey>_<o_orderpriority>``; index variants by key % 13
                      (0 none, 1 ``index.yml``, 2 empty display name, 3 no url_name,
                      4 unparsable YAML); every course also has an unnumbered ``Appendix`` folder
* block      lineitem file ``<nn>_b`` + ``.prob.md`` (flag R) / ``.md`` (A) / ``.repl.yaml`` (N),
                      nn = position of the line in its order by all its columns
* repl files lineitem ``<nn>_b.repl/src/main.<ext>`` and ``<nn>_b.repl/test/test_main.<ext>``
* code       lineitem string-form problems on even lines answer ``=#!exl::repl('<nn>_b.prob.repl.yaml')``;
                      that file and ``<nn>_b.prob.repl/src/solution.py`` exist except on line 6
* files      documents also as real files, with binary, ignored and undecodable ones (``document_tree``)
* commits    lineitem two per block file unless quantity > 45; one per repl source file;
                      one per vertical index file
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> Column:
    return F.col(c).cast("string")


# --------------------------------------------------------------------------------------
# folder names per level


def _chapter_folders(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("R"), _s("n_regionkey")).alias("course_id"),
                    F.col("n_nationkey"), F.col("n_name"),
                    F.concat(_s("n_nationkey"), F.lit("_"), F.col("n_name")).alias("chf"))


def _sequential_folders(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    ch = _chapter_folders(spark, sf_dir)
    return (c.join(ch, c.c_nationkey == ch.n_nationkey)
            .select("course_id", "chf", "c_custkey", "c_name", "c_mktsegment",
                    F.concat(_s("c_custkey"), F.lit("_"), F.col("c_name")).alias("sqf")))


def _vertical_folders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    sq = _sequential_folders(spark, sf_dir)
    return (o.join(sq, o.o_custkey == sq.c_custkey)
            .select("course_id", "chf", "sqf", "o_orderkey", "o_orderdate",
                    F.concat_ws("/", "chf", "sqf",
                                F.concat(_s("o_orderkey"), F.lit("_"), F.col("o_orderpriority"))).alias("vpath")))


def problem_markdown(kind: Column, name: Column, ptype: Column, brand: Column, price: Column) -> Column:
    """Problem Markdown text for one part, form chosen by ``kind`` (p_size % 5)."""
    label = F.concat(F.lit(">>"), name, F.lit("||"), ptype, F.lit("<<\n\n"))
    hint = F.concat(F.lit("\n|| "), brand, F.lit(" ||\n"))
    single = F.concat(label, F.lit("(x) "), brand, F.lit(" {{Right:: "), ptype, F.lit("}}\n"),
                      F.lit("( ) "), ptype, F.lit("\n(!@) "), name, F.lit("\n"), hint)
    multi = F.concat(label, F.lit("[x] "), brand, F.lit(" {{selected: yes "), ptype,
                     F.lit("},{unselected: no "), ptype, F.lit("}}\n[ ] "), ptype,
                     F.lit("\n[x] "), name, F.lit("\n"), hint)
    dropdown = F.concat(label, F.lit("[["), ptype, F.lit(", ("), brand, F.lit("), "), name, F.lit("]]\n"),
                        F.lit("\n---\n+(x) ```\nprint('"), brand, F.lit("')\n``` -(x)-\n+( ) "), ptype,
                        F.lit(" -( )-\n"))
    numeric = F.concat(label, F.lit("= "), price.cast("string"), F.lit(" +- 0.5\nor= "),
                       (price + F.lit(1)).cast("string"), F.lit("\n"))
    string = F.concat(label, F.lit("s= "), brand, F.lit("\nor= "), ptype, F.lit("\nnot= "), name,
                      F.lit(" {{Not "), name, F.lit("}}\n"), hint)
    return (F.when(kind == 0, single).when(kind == 1, multi).when(kind == 2, dropdown)
            .when(kind == 3, numeric).otherwise(string))


def problem_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One problem Markdown document per part: ``doc_id, text``."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("doc_id"),
                    problem_markdown(F.col("p_size") % 5, F.col("p_name"), F.col("p_type"),
                                     F.col("p_brand"), F.col("p_retailprice")).alias("text"))


def code_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with inline and fenced code for the escaping functions: ``doc_id, variant, text``."""
    p = table(spark, sf_dir, "part")
    inline = F.concat(F.col("p_name"), F.lit(" `a|"), _s("p_size"), F.lit("&b` c"))
    fenced = F.concat(F.lit("```\n"), F.col("p_name"), F.lit(" <x> | y & z\n```"))
    return p.select(F.col("p_partkey").alias("doc_id"),
                    F.explode(F.array(F.struct(F.lit("inline").alias("variant"), inline.alias("text")),
                                      F.struct(F.lit("fenced").alias("variant"), fenced.alias("text")))).alias("d")
                    ).select("doc_id", "d.variant", "d.text")


def markup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTML and one Markdown text per part, in six forms by p_size % 6: nested and numbered lists,
    quotes, tables, fenced code, entities, elements that are not closed: ``doc_id, html, markdown``."""
    p = table(spark, sf_dir, "part")
    n, t, b, k = F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.col("p_size") % 6

    def form(texts: list[str]) -> Column:
        out = None
        for i, text in enumerate(texts):
            filled = F.replace(F.replace(F.replace(F.lit(text), F.lit("{n}"), n), F.lit("{t}"), t), F.lit("{b}"), b)
            out = F.when(k == i, filled) if out is None else out.when(k == i, filled)
        return out

    html = ["<ol><li>{n}</li><li>{t}<ul><li>{b}</li><li><b>{n}</b></li></ul></li></ol><p>after</p>",
            "<blockquote><p>{n}</p><ul><li>{t}</ul></blockquote>&#8217;{b}&#x2014;&amp;",
            "<table><thead><tr><th>{n}</th><th>k</th></tr></thead><tbody><tr><td>{t}|x</td><td><code>{b}</code></td></tr></tbody></table>",
            "<pre><code class=\"language-py\">if a &lt; b:\n  # {n}</code></pre><h3>{t}</h3>",
            "<p>{n}<br>{t}<p><i>{b}</i> <a href=\"/x\">{n}</a> <b>open<hr>",
            "<ol start=\"9\"><li><p>{n}</p><p>{t}</p></li><li>{b}</ol>"]
    markdown = ["1. {n}\n2. {t}\n   - {b}\n   - **{n}**\n\nafter", "```py\n**{n}** <{t}>\n\n# {b}\n```\ntail",
                "{n} `**{t}**` and *{b}*\nsecond line\n\n> {n}\n> more", "| {n} | k |\n|---|:-:|\n| {t} | `{b}` |",
                "- {n}\n\n- {t}\n\n## {b}\n---", "{n}\n===\n{t}  \n{b}"]
    return p.select(F.col("p_partkey").alias("doc_id"), form(html).alias("html"), form(markdown).alias("markdown"))


def _block_lines(spark, sf_dir) -> DataFrame:
    """Line items with their order's folder and their position in the order. Lines are dealt by order
    once, with their part: a line that several part rows match keeps one position (``_line`` tells
    lines apart that are equal in all columns)."""
    li = table(spark, sf_dir, "lineitem")
    order_all = [F.col(c) for c in li.columns if c != "l_orderkey"]
    p = table(spark, sf_dir, "part").withColumn("_part", F.lit(True))
    nn = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy(*order_all, "_line")) - 1
    v = _vertical_folders(spark, sf_dir).select("course_id", "o_orderkey", "vpath")
    return (li.withColumn("_line", F.monotonically_increasing_id())
            .join(p, li.l_partkey == p.p_partkey, "left")
            .withColumn("nn", nn).filter("_part").drop("_line", "_part")
            .join(v, F.col("l_orderkey") == v.o_orderkey)
            .withColumn("base", F.concat(F.format_string("%02d", F.col("nn")), F.lit("_b")))
            .withColumn("ext", F.when(F.col("l_returnflag") == "R", F.lit(".prob.md"))
                        .when(F.col("l_returnflag") == "A", F.lit(".md"))
                        .otherwise(F.lit(".repl.yaml")))
            .withColumn("bpath", F.concat_ws("/", "vpath", F.concat("base", "ext"))))


def course_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``files`` table of every course tree: ``course_id, path, content``."""
    r = table(spark, sf_dir, "region")
    k = F.col("r_regionkey")
    timekit = F.when(k % 2 == 0, F.struct(F.array(F.struct(
        k.cast("long").alias("credits"), F.concat(F.lit("p"), _s("r_regionkey")).alias("project_id"),
        F.lit(3600).cast("long").alias("duration_seconds"))).alias("intervals")))
    course_doc = F.struct(
        F.concat(F.lit("R"), _s("r_regionkey")).alias("url_name"),
        F.col("r_name").alias("display_name"),
        F.lit("acme").alias("org"),
        F.concat(F.lit("c"), _s("r_regionkey")).alias("course"),
        F.concat(F.lit("images/c"), _s("r_regionkey"), F.lit(".png")).alias("course_image"),
        F.lit("en").alias("language"),
        F.concat(F.col("r_name"), F.lit(" in depth")).alias("headline"),
        F.concat(F.lit("All about "), F.col("r_name")).alias("description"),
        F.array(F.col("r_name"), F.lit("all")).alias("topics"),
        F.col("r_name").alias("primary_topic"),
        F.when(k == 4, F.lit("x")).otherwise(F.lit("")).alias("skill_level"),
        F.lit("").alias("info_md"),
        F.when(k == 0, F.lit("https://gitlab.com/acme/c0"))
        .otherwise(F.concat(F.lit("https://github.com/acme/c"), _s("r_regionkey"))).alias("repo_url"),
        k.alias("weight"),
        ((k + 1) * 60).alias("est_minutes"),
        timekit.alias("instructor_timekit"),
    )
    cid = F.concat(F.lit("R"), _s("r_regionkey"))
    courses = r.select(cid.alias("course_id"), F.lit("index.yaml").alias("path"),
                       F.to_json(course_doc).alias("content"))
    ignored = r.select(cid.alias("course_id"),
                       F.explode(F.array(F.lit("assets/logo.png"), F.lit("drafts/01_Next/index.yaml"),
                                         F.lit(".git/config"))).alias("path"),
                       F.col("r_name").alias("content"))
    # a chapter folder without the "<n>_" prefix: invalid name, left out of the tree
    appendix = r.select(cid.alias("course_id"), F.lit("Appendix/index.yaml").alias("path"),
                        F.to_json(F.struct(F.concat(F.lit("A"), _s("r_regionkey")).alias("url_name"),
                                           F.lit("Appendix").alias("display_name"))).alias("content"))

    ch = _chapter_folders(spark, sf_dir)
    chapters = ch.select("course_id", F.concat("chf", F.lit("/index.yaml")).alias("path"),
                         F.to_json(F.struct(F.concat(F.lit("N"), _s("n_nationkey")).alias("url_name"),
                                            F.col("n_name").alias("display_name"))).alias("content"))

    sq = _sequential_folders(spark, sf_dir)
    seqs = sq.select("course_id", F.concat_ws("/", "chf", "sqf", F.lit("index.yaml")).alias("path"),
                     F.to_json(F.struct(
                         F.concat(F.lit("C"), _s("c_custkey")).alias("url_name"),
                         F.col("c_name").alias("display_name"),
                         (F.col("c_mktsegment") == "HOUSEHOLD").alias("graded"),
                         F.when(F.col("c_custkey") % 2 == 0, F.lit("Final Exam"))
                         .otherwise(F.lit("Homework")).alias("format"))).alias("content"))

    vf = _vertical_folders(spark, sf_dir)
    variant = F.col("o_orderkey") % 13
    vid = F.concat(F.lit("O"), _s("o_orderkey"))
    vtitle = F.concat(F.lit("Order "), _s("o_orderkey"))
    vdoc = (F.when(variant == 2, F.to_json(F.struct(vid.alias("url_name"), F.lit("").alias("display_name"))))
            .when(variant == 4, F.concat(F.lit("display_name: [unclosed "), vtitle))
            .when(variant == 3, F.to_json(F.struct(vtitle.alias("display_name"))))
            .otherwise(F.to_json(F.struct(vid.alias("url_name"), vtitle.alias("display_name")))))
    verts = (vf.filter(variant != 0)
             .select("course_id",
                     F.concat_ws("/", "vpath", F.when(variant == 1, F.lit("index.yml"))
                                 .otherwise(F.lit("index.yaml"))).alias("path"),
                     vdoc.alias("content")))

    bl = _block_lines(spark, sf_dir)
    env = F.when(F.col("l_linestatus") == "O", F.lit("python_3_4_free")).otherwise(F.lit("javascript_default_free"))
    repl_doc = F.to_json(F.struct(
        F.when(F.col("l_linenumber") == 7, F.lit(2)).otherwise(F.lit(1)).alias("api_version"),
        env.alias("environment"),
        F.concat("base", F.lit(".repl/src")).alias("src_path"),
        F.col("p_name").alias("explanation"),
        F.concat("base", F.lit(".repl/test")).alias("test_path"),
        F.struct(F.lit("500px").alias("height")).alias("display"),
        F.create_map(F.lit("main"), F.array(F.col("p_type"))).alias("tests"),
    ))
    code_q = (F.col("l_returnflag") == "R") & (F.col("p_size") % 5 == 4) & (F.col("l_linenumber") % 2 == 0)
    code_md = F.concat(F.lit(">>"), F.col("p_name"), F.lit("||"), F.col("p_type"), F.lit("<<\n\n=#!exl::repl('"),
                       F.col("base"), F.lit(".prob.repl.yaml')\n\n|| "), F.col("p_brand"), F.lit(" ||\n"))
    content = (F.when(code_q, code_md)
               .when(F.col("l_returnflag") == "R",
                      problem_markdown(F.col("p_size") % 5, F.col("p_name"), F.col("p_type"),
                                       F.col("p_brand"), F.col("p_retailprice")))
               .when(F.col("l_returnflag") == "A", F.concat(F.col("p_name"), F.lit(" "), F.col("p_type")))
               .otherwise(repl_doc))
    # every file of a line: the block, an editor's source and test, a code question's repl settings
    # (missing on line 6) and its sources
    def file(when: Column, path: Column, text: Column) -> Column:
        return F.when(when, F.struct(path.alias("path"), text.alias("content")))

    beside = lambda *parts: F.concat_ws("/", "vpath", F.concat("base", *parts))
    ext = F.when(F.col("l_linestatus") == "O", F.lit("py")).otherwise(F.lit("js"))
    editor, has_code = F.col("l_returnflag") == "N", code_q & (F.col("l_linenumber") != 6)
    code_repl = F.to_json(F.struct(
        F.lit(1).alias("api_version"), F.lit("python_3_4_free").alias("environment"),
        F.concat("base", F.lit(".prob.repl/src")).alias("src_path"), F.col("p_name").alias("explanation"),
        F.create_map(F.lit("main"), F.array(F.col("p_type"))).alias("tests")))
    line_files = (bl.select("course_id", F.explode(F.array(
        file(F.lit(True), F.col("bpath"), content),
        file(editor, beside(F.lit(".repl/src/main."), ext), F.concat(F.col("p_type"), F.lit(" "), F.col("p_name"))),
        file(editor, beside(F.lit(".repl/test/test_main."), ext), F.concat(F.lit("assert "), _s("p_size"))),
        file(has_code, beside(F.lit(".prob.repl.yaml")), code_repl),
        file(has_code, beside(F.lit(".prob.repl/src/solution.py")), F.col("p_type")))).alias("f"))
        .filter(F.col("f").isNotNull()).select("course_id", "f.path", "f.content"))
    return (courses.unionByName(ignored).unionByName(appendix).unionByName(chapters).unionByName(seqs)
            .unionByName(verts).unionByName(line_files))


def course_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit log: ``course_id, path, commit_id, author_ts, committer_ts``."""
    bl = _block_lines(spark, sf_dir)
    ship = F.col("l_shipdate")
    day = F.expr("INTERVAL 1 DAY")
    shift = F.when(F.col("l_linenumber") % 2 == 1, -10).otherwise(10)
    base_id = F.concat(_s("l_orderkey"), F.lit("-"), F.col("base"))
    ext = F.when(F.col("l_linestatus") == "O", F.lit("py")).otherwise(F.lit("js"))

    def commit(when: Column, path: Column, mark: str, author: Column, committer: Column) -> Column:
        return F.when(when, F.struct(path.alias("path"), F.concat(F.lit(mark), base_id).alias("commit_id"),
                                     author.alias("author_ts"), committer.alias("committer_ts")))

    few, third = F.col("l_quantity") <= 45, ship + F.make_dt_interval(F.lit(3))
    line_commits = (bl.select("course_id", F.explode(F.array(
        commit(few, F.col("bpath"), "a", ship, ship),
        commit(few, F.col("bpath"), "b", ship + F.make_dt_interval(shift), ship + day),
        commit(F.col("l_returnflag") == "N", F.concat_ws("/", "vpath", F.concat("base", F.lit(".repl/src/main."), ext)),
               "s", third, third))).alias("c"))
        .filter(F.col("c").isNotNull()).select("course_id", "c.*"))
    vf = _vertical_folders(spark, sf_dir)
    variant = F.col("o_orderkey") % 13
    idx_commits = (vf.filter(variant != 0)
                   .select("course_id",
                           F.concat_ws("/", "vpath", F.when(variant == 1, F.lit("index.yml"))
                                       .otherwise(F.lit("index.yaml"))).alias("path"),
                           F.concat(F.lit("i"), _s("o_orderkey")).alias("commit_id"),
                           (F.col("o_orderdate") + F.make_dt_interval(F.lit(1000))).alias("author_ts"),
                           (F.col("o_orderdate") + F.make_dt_interval(F.lit(1000))).alias("committer_ts")))
    return line_commits.unionByName(idx_commits)


# --------------------------------------------------------------------------------------
# workspace stand-ins (one workspace "docs" holding every document as a file)


def workspace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat workspace rows: ``ws, path, name, is_dir, is_tmpl, is_immutable, is_hidden, contents``.

    Files ``<source>/<lang>/<doc_id>.js`` hold the whole document text; toxic documents are
    hidden files, quality-0 documents immutable; the ``<source>/fr`` folders are hidden."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    files = j.select(F.lit("docs").alias("ws"),
                     F.concat_ws("/", "source", "lang", F.concat(_s("doc_id"), F.lit(".js"))).alias("path"),
                     F.concat(_s("doc_id"), F.lit(".js")).alias("name"),
                     F.lit(False).alias("is_dir"), F.lit(False).alias("is_tmpl"),
                     (F.coalesce(F.col("quality"), F.lit(1)) == 0).alias("is_immutable"),
                     (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("is_hidden"),
                     F.col("text").alias("contents"))
    src = d.select(F.col("source").alias("path")).distinct().select(
        F.lit("docs").alias("ws"), "path", F.col("path").alias("name"), F.lit(True).alias("is_dir"),
        F.lit(False).alias("is_tmpl"), F.lit(False).alias("is_immutable"), F.lit(False).alias("is_hidden"),
        F.lit(None).cast("string").alias("contents"))
    lang = d.select("source", "lang").distinct().select(
        F.lit("docs").alias("ws"), F.concat_ws("/", "source", "lang").alias("path"), F.col("lang").alias("name"),
        F.lit(True).alias("is_dir"), F.lit(False).alias("is_tmpl"), F.lit(False).alias("is_immutable"),
        (F.col("lang") == "fr").alias("is_hidden"), F.lit(None).cast("string").alias("contents"))
    return files.unionByName(src).unionByName(lang)


def path_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lookup per document by doc_id % 4: ``./path``, ``/path``, ``path``, a missing path."""
    d = table(spark, sf_dir, "documents")
    p = F.concat_ws("/", "source", "lang", F.concat(_s("doc_id"), F.lit(".js")))
    k = F.col("doc_id") % 4
    req = (F.when(k == 0, F.concat(F.lit("./"), p)).when(k == 1, F.concat(F.lit("/"), p))
           .when(k == 2, p).otherwise(F.concat(p, F.lit(".missing"))))
    return d.select(F.lit("docs").alias("ws"), F.col("doc_id").alias("request_id"), req.alias("request"))


def file_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by doc_id % 5: 0 rewrite the file; 1 remove it (German documents: the folder
    ``<source>/new<doc_id % 3>``); 2 write a file into that folder (Spanish documents: remove
    ``<source>/es``); 3 write a new ``.txt`` file beside the file; 4 make that folder (Spanish: ``<source>/es``)."""
    d = table(spark, sf_dir, "documents")
    k, es = F.col("doc_id") % 5, F.col("lang") == "es"
    base, home = F.concat_ws("/", "source", "lang", _s("doc_id")), F.concat_ws("/", "source", "lang")
    made = F.concat(F.col("source"), F.lit("/new"), (F.col("doc_id") % 3).cast("string"))
    edit = lambda op, path, contents=F.lit(None).cast("string"): F.struct(F.lit(op).alias("op"), path.alias("path"), contents.alias("contents"))
    new = F.concat(F.lit("new "), _s("doc_id"))
    e = (F.when(k == 0, edit("write", F.concat(base, F.lit(".js")), F.concat(F.lit("edited "), _s("doc_id"))))
         .when((k == 1) & (F.col("lang") == "de"), edit("remove", made)).when(k == 1, edit("remove", F.concat(base, F.lit(".js"))))
         .when((k == 2) & es, edit("remove", home)).when(k == 2, edit("write", F.concat(made, F.lit("/"), _s("doc_id"), F.lit(".txt")), new))
         .when(k == 3, edit("write", F.concat(base, F.lit(".txt")), new))
         .when(es, edit("mkdir", home)).otherwise(edit("mkdir", made)))
    return d.select(F.lit("docs").alias("ws"), F.col("doc_id").alias("seq"), e.alias("e")).select("ws", "seq", "e.*")


def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course trees for real files, as ``(course_id, path, content)`` with bytes: one course per
    source, ``<lang>`` chapter, doc_id % 4 sequential, doc_id % 16 vertical, a ``.md`` block per document.
    Toxic documents begin with a byte that UTF-8 never has; documents of quality 0 have a picture
    below ``assets``, every tenth an object below ``.git`` and a draft (none of which is to be read),
    every fiftieth a ``__init__.py`` in a repl folder, document 3 and every 97th after it a file in a folder
    below a level that is none (VAL-3). Courses whose name ends in 7 have no index (VAL-1), ``src3``'s is not text."""
    d = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    i = F.col("doc_id")
    chapter, id_ = F.concat(F.lit("1_"), F.col("lang")), _s("doc_id")
    seq = F.concat_ws("/", chapter, F.concat((i % 4).cast("string"), F.lit("_part")))
    vert = F.concat_ws("/", seq, F.concat((i % 16).cast("string"), F.lit("_card")))
    text, bad, noise = F.col("text").cast("binary"), F.unhex(F.lit("FF")), F.unhex(F.lit("89504E470D0A1A0AFFFE"))
    file = lambda when, path, content: F.when(when, F.struct(path.alias("path"), content.alias("content")))
    files = F.array(
        file(F.lit(True), F.concat(vert, F.lit("/"), id_, F.lit("_doc.md")), F.when(F.coalesce("toxic", F.lit(0)) == 1, F.concat(bad, text)).otherwise(text)),
        file(F.coalesce("quality", F.lit(1)) == 0, F.concat(chapter, F.lit("/assets/"), id_, F.lit(".png")), noise),
        file(i % 10 == 0, F.concat(F.lit(".git/objects/"), id_), noise),
        file(i % 10 == 0, F.concat(seq, F.lit("/drafts/"), id_, F.lit("_x/"), id_, F.lit(".md")), text),
        file(i % 50 == 0, F.concat(vert, F.lit("/"), id_, F.lit("_doc.repl/src/__init__.py")), F.concat(F.lit("n = "), id_).cast("binary")),
        file(i % 97 == 3, F.concat(seq, F.lit("/"), id_, F.lit("_x.repl/inner/"), id_, F.lit(".md")), text))
    rows = d.select(F.col("source").alias("course_id"), F.explode(F.filter(files, lambda f: f.isNotNull())).alias("f")).select("course_id", "f.*")
    index = d.select("source").distinct().where(~F.col("source").endswith("7")).select(
        F.col("source").alias("course_id"), F.lit("index.yaml").alias("path"),
        F.when(F.col("source") == "src3", F.concat(bad, F.lit("x").cast("binary")))
        .otherwise(F.concat(F.lit("url_name: "), "source", F.lit("\ndisplay_name: "), "source", F.lit("\n")).cast("binary")).alias("content"))
    return rows.unionByName(index)


_TREES: dict[tuple[int, str], str] = {}


def stored_document_tree(spark: SparkSession, sf_dir: str) -> str:
    """The folder below which the document tree lies as real files (written once a session)."""
    import hashlib
    import os

    from lectern.session import run_dir
    from lectern.sinks.export import write_files

    root = f"{run_dir(spark)}/lectern-tree/{hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]}"
    if (id(spark), root) not in _TREES:
        write_files(document_tree(spark, sf_dir), root)
        _TREES[(id(spark), root)] = root
    return root


# --------------------------------------------------------------------------------------
# materialisation: the stand-in is written once per session as parquet below the shared
# checkpoint folder, so every query scans a stored catalogue (as a deployment would)
# instead of re-deriving it from the driver's tables.

_WRITTEN: set[tuple[int, str]] = set()


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    import hashlib
    import os

    from lectern.session import run_dir

    tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
    path = f"{run_dir(spark)}/lectern-catalogue/{tag}/{name}"
    key = (id(spark), path)
    if key not in _WRITTEN:
        build(spark, sf_dir).write.mode("overwrite").parquet(path)
        _WRITTEN.add(key)
    return spark.read.parquet(path)


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "files", course_files)


def stored_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "commits", course_commits)
