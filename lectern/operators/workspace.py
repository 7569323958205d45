"""Workspaces of code blocks: SRC-6, JOIN-4, JOIN-7, JOIN-8, PRJ-22 … PRJ-25, AGG-5, VAL-4/6/10.

A workspace is a folder tree; Spark has no recursive types, so it is kept flat — one row
per file or folder with its path relative to the workspace root — and nested only when
a JSON document is written (PRJ-24).

Prefix relations ("every file below folder X") are equi-joins on exploded ancestor
folders, never ``startswith`` join conditions (those plan as nested loops).
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.ids import derived_id, join_keyed, keyed
from lectern.functions.paths import resolve_path
from lectern.functions.text import url_query_escape
from lectern.sources.tree import REPL_SCHEMA, parse_yaml

# Accepted repl environments and API version.
VALID_ENVIRONMENTS = ["java_default_free", "python_2_7_free", "python_3_4_free", "javascript_default_free"]
VALID_API_VERSION = 1
# The folders a java workspace is wrapped in (template folders).
JAVA_WRAPPER = ["src", "main", "java", "exlcode"]
JAVA_WRAPPER_XML = ["src", "main", "java", "exlhub"]
MAX_DEPTH = 14
EMBED_URL = "https://exlcode.com/repl?embedded=true&workspace="
ROLES = ["src", "tmpl", "test"]


def parse_repls(blocks: DataFrame) -> DataFrame:
    """Typed repl settings of editor blocks (``.repl.yaml`` content): adds ``repl`` struct
    and ``repl_error`` (parse failure)."""
    p = parse_yaml(F.col("content"), REPL_SCHEMA)
    d = blocks.withColumn("_p", p)
    doc = F.col("_p.doc")
    api = doc["api_version"]
    return d.withColumn("repl", F.struct(
        F.when(api.rlike(r"^[+-]?[0-9]+$"), api.try_cast("int")).alias("api_version"),
        F.coalesce(doc["environment"], F.lit("")).alias("environment"),
        F.coalesce(doc["src_path"], F.lit("")).alias("src_path"),
        F.coalesce(doc["tmpl_path"], F.lit("")).alias("tmpl_path"),
        F.coalesce(doc["test_path"], F.lit("")).alias("test_path"),
        F.coalesce(doc["explanation"], F.lit("")).alias("explanation"),
        doc["display"]["height"].alias("height"),
        doc["tests"].alias("tests"),
        F.coalesce(F.nullif(doc["grading_strategy"], F.lit("")), F.lit("default")).alias("grading_strategy"),
    )).withColumn("repl_error", F.col("_p.error")).drop("_p")


def ancestors(path: Column) -> Column:
    """Proper ancestor folders of a relative path (``a/b/c`` → ``[a, a/b]``)."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                                                 lambda i: F.array_join(F.slice(parts, 1, i), "/"))
                  ).otherwise(F.array().cast("array<string>"))


def repl_roles(repls: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (repl, role) with a non-empty path: ``role``, ``role_dir`` (course-relative)."""
    r = repls.select(*keys, "folder", F.col("repl.environment").alias("environment"),
                     F.explode(F.array(*[F.struct(F.lit(role).alias("role"),
                                                  F.col(f"repl.{role}_path").alias("rel"))
                                         for role in ROLES])).alias("x"))
    return (r.filter(F.col("x.rel") != "")
            .select(*keys, "environment", F.col("x.role").alias("role"),
                    resolve_path(F.concat_ws("/", F.col("folder"), F.col("x.rel"))).alias("role_dir")))


def attach_files(roles: DataFrame, files: DataFrame, keys: list[str], wrapper: list[str] | None = None,
                 stage=None, name: str = "workspace_files") -> DataFrame:
    """JOIN-4 + SRC-6: every file below each role folder, as workspace rows.

    ``files`` needs ``course_id, path, content``. Role folders are matched by equality with a file's
    ancestor folders, at those depths alone at which there are role folders (they are collected: a
    handful of numbers); files that lie less deep do not move. The relative path is cut, java
    workspaces are wrapped below ``src/main/java/exlcode`` and folder rows are made from the distinct
    ancestors of the relative paths. ``stage(name, df)`` may persist the files before folders are made.
    """
    wrapper = JAVA_WRAPPER if wrapper is None else wrapper
    found = roles.filter(F.col("role_dir").isNotNull()).select(F.size(F.split("role_dir", "/"))).distinct().collect()
    depths = sorted(r[0] for r in found)
    above = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    held = files.filter(above >= min(depths, default=0) if depths else F.lit(False)).select("course_id", "path", "content")
    if len(depths) == 1:
        below = held.withColumn("role_dir", F.substring_index("path", "/", depths[0]))
    else:
        folders = [F.when(above >= d, F.substring_index("path", "/", d)) for d in depths] or [F.lit(None).cast("string")]
        below = held.withColumn("role_dir", F.explode(F.array(*folders))).filter(F.col("role_dir").isNotNull())
    hit = join_keyed(roles, below, ["course_id", "role_dir"])
    rel = F.expr("substring(path, length(role_dir) + 2)")
    java = F.col("environment") == "java_default_free"
    prefix = "/".join(wrapper) + "/"
    f = hit.select(*keys, "environment", "role",
                   F.when(java, F.concat(F.lit(prefix), rel)).otherwise(rel).alias("path"),
                   F.col("content").alias("contents"))
    f = f if stage is None else stage(name, f)
    leaf = f.select(*keys, "environment", "role", "path", F.lit(False).alias("is_dir"),
                    F.lit(False).alias("is_tmpl"), "contents")
    dirs = (f.select(*keys, "environment", "role", F.explode(ancestors(F.col("path"))).alias("path"))
            .distinct())
    wrapper_dirs = {"/".join(wrapper[:i]) for i in range(1, len(wrapper) + 1)}
    dirs = dirs.select(*keys, "environment", "role", "path", F.lit(True).alias("is_dir"),
                       (java & F.col("path").isin(*wrapper_dirs)).alias("is_tmpl"),
                       F.lit(None).cast("string").alias("contents"))
    out = leaf.unionByName(dirs)
    return out.select(*keys, "role", "environment", "path", F.element_at(F.split("path", "/"), -1).alias("name"),
                      "is_dir", "is_tmpl", F.lit(False).alias("is_immutable"), F.lit(False).alias("is_hidden"),
                      "contents")


def missing_role_dirs(roles: DataFrame, ws_files: DataFrame, keys: list[str]) -> DataFrame:
    """VAL-6: role folders with no file below them."""
    return roles.join(ws_files.select(*keys, "role").distinct(), [*keys, "role"], "left_anti")


# ----------------------------------------------------------------------------- JSON

_JSON_OUT = T.StructType([T.StructField("json", T.StringType()), T.StructField("files_json", T.StringType()),
                          T.StructField("error", T.StringType())])


def _go_json(obj) -> str:
    """JSON text the way the reference's encoder writes it (HTML-safe escapes)."""
    s = json.dumps(obj, ensure_ascii=False, separators=(",", ":"))
    return (s.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
            .replace("\u2028", "\\u2028").replace("\u2029", "\\u2029"))


def _nested(rows: list[dict]) -> tuple[dict, str | None]:
    """The folder tree of a workspace's rows, names in order, and what is wrong with it."""
    tree: dict = {}
    err, nested = None, False
    for r in sorted(rows, key=lambda r: r["path"]):
        parts = r["path"].split("/")
        if len(parts) > MAX_DEPTH + 1:
            err = "workspace file structure is too deep"
        if r.get("is_hidden"):
            err = "cannot serialise a hidden file"
        node = {"name": parts[-1], "isDir": bool(r.get("is_dir")), "isTmplFile": bool(r.get("is_tmpl")),
                "isImmutable": bool(r.get("is_immutable"))}
        if r.get("contents"):
            node["contents"] = r["contents"]
        level = tree
        for p in parts[:-1]:
            nested = True
            parent = level.setdefault(p, {"name": p, "isDir": True, "isTmplFile": False, "isImmutable": False})
            level = parent.setdefault("children", {})
        existing = level.get(parts[-1])
        if existing is not None and "children" in existing:
            node["children"] = existing["children"]
        level[parts[-1]] = node

    def order(d):
        res = {}
        for k in sorted(d):
            n = dict(d[k])
            if "children" in n:
                n["children"] = order(n["children"])
            res[k] = n
        return res

    return (order(tree) if nested else tree), err  # the rows of one folder came in order


@F.pandas_udf(_JSON_OUT)
def _nest_workspace(ids: pd.Series, names: pd.Series, envs: pd.Series, rows: pd.Series) -> pd.DataFrame:
    """One document per workspace; ``rows`` has its files and folders as a JSON list."""
    out_json, out_files, out_err = [], [], []
    for wid, name, env, text in zip(ids.tolist(), names.tolist(), envs.tolist(), rows.tolist()):
        tree, err = _nested(json.loads(text) if text else [])
        files = None if err else _go_json(tree)
        key = f',"environmentKey":{_go_json(env)}' if env else ""
        out_json.append(None if err else f'{{"id":{_go_json(wid)},"name":{_go_json(name or "")}{key},"files":{files}}}')
        out_files.append(files)
        out_err.append(err)
    return pd.DataFrame({"json": out_json, "files_json": out_files, "error": out_err})


def workspace_json(ws_files: DataFrame, keys: list[str], names: DataFrame | None = None,
                   name_col: str = "display_name") -> DataFrame:
    """PRJ-24: one JSON workspace document per (keys, role): ``{id, name, environmentKey, files}``; beside
    it ``source_text`` and ``js_code`` of source workspaces.

    Files of one workspace are gathered with ``collect_list`` (a workspace is one
    document by definition); the nesting runs in one vectorised helper per batch.
    """
    g = (keyed(ws_files, keys).groupBy("_key", *keys, "role")
         .agg(F.first("environment").alias("environment"),
              F.collect_list(F.struct("path", "is_dir", "is_tmpl", "is_immutable", "is_hidden", "contents")).alias("fs")))
    if names is not None:
        g = g.join(keyed(names.select(*keys, F.col(name_col).alias("ws_name")), keys), ["_key", *keys], "left")
    else:
        g = g.withColumn("ws_name", F.lit(""))
    wid = derived_id(*[F.col(k).cast("string") for k in keys], F.col("role"))
    j = _nest_workspace(wid, F.coalesce("ws_name", F.lit("")), F.col("environment"), F.to_json("fs"))
    src = F.col("role") == "src"
    return g.select(*keys, "role", "environment", F.when(src, source_text(F.col("fs"))).alias("source_text"),
                    F.when(src, js_editor_code(F.col("fs"))).alias("js_code"), j.alias("j")).select(
        *keys, "role", "environment", F.col("j.json").alias("workspace_json"), F.col("j.files_json").alias("files_json"),
        F.col("j.error").alias("json_error"), "source_text", "js_code")


def embed_frame(src_json: Column) -> Column:
    """PRJ-22: the embedded-editor iframe for a source workspace JSON ('' → empty workspace)."""
    url = F.concat(F.lit(EMBED_URL.replace("&", "&amp;")), url_query_escape(F.coalesce(src_json, F.lit(""))))
    return F.concat(F.lit('<iframe src="'), url, F.lit('" width="100%" height="500px"></iframe>'))


def _go_json_escape(c: Column) -> Column:
    c = F.replace(c, F.lit("<"), F.lit("\\u003c"))
    c = F.replace(c, F.lit(">"), F.lit("\\u003e"))
    return F.replace(c, F.lit("&"), F.lit("\\u0026"))


def _in_order(fs: Column, text) -> Column:
    """A text for each file of a gathered workspace, joined in path order."""
    files = F.transform(F.filter(fs, lambda f: ~f["is_dir"]), lambda f: F.struct(f["path"].alias("path"), f["contents"].alias("contents")))
    return F.array_join(F.transform(F.array_sort(files), lambda f: text(f["path"], F.coalesce(f["contents"], F.lit("")))), "")


def js_editor_code(fs: Column) -> Column:
    """PRJ-23 (input): top-level ``.js`` files of a gathered workspace, each ``// name\\ncontents\\n``, in
    name order."""
    js = F.filter(fs, lambda f: ~f["path"].contains("/") & f["path"].endswith(".js"))
    return _in_order(js, lambda path, contents: F.concat(F.lit("// "), path, F.lit("\n"), contents, F.lit("\n")))


def embed_editor(js_code: Column) -> Column:
    """PRJ-23: the JavaScript editor block: js/css/html pane document in a boilerplate div."""
    doc = F.to_json(F.struct(
        F.struct(F.coalesce(js_code, F.lit("")).alias("code"), F.lit("js").alias("transformer")).alias("js"),
        F.struct(F.lit("").alias("code"), F.lit("css").alias("transformer")).alias("css"),
        F.struct(F.lit("").alias("code"), F.lit("html").alias("transformer")).alias("html"),
        F.array(F.lit("js"), F.lit("console")).alias("showPans"),
        F.lit("js").alias("activePan")))
    return F.concat(F.lit('<div class="js-cp-boilerplate">'), _go_json_escape(doc), F.lit("</div>"))


def source_text(fs: Column) -> Column:
    """AGG-5: all file contents of a gathered workspace concatenated in path order."""
    return _in_order(fs, lambda path, contents: contents)


def repl_violations(repls: DataFrame, keys: list[str]) -> DataFrame:
    """VAL-4: api_version must be 1 and the environment one of the supported ones."""
    bad_api = F.col("repl.api_version").isNull() | (F.col("repl.api_version") != VALID_API_VERSION)
    bad_env = ~F.col("repl.environment").isin(*VALID_ENVIRONMENTS)
    msg = (F.when(F.col("repl_error").isNotNull(), F.concat(F.lit("unparsable repl: "), F.col("repl_error")))
           .when(bad_api, F.concat(F.lit("invalid repl api_version "), F.coalesce(F.col("repl.api_version").cast("string"), F.lit(""))))
           .when(bad_env, F.concat(F.lit("invalid repl environment "), F.col("repl.environment"))))
    return repls.select(*keys, msg.alias("message")).filter(F.col("message").isNotNull())


# --------------------------------------------------------------------- path requests


def normalize_request(p: Column) -> Column:
    """JOIN-7: ``/a/b``, ``./a/b`` and ``a/b`` name the same file."""
    return F.when(p.startswith("/"), F.substr(p, F.lit(2))).when(p.startswith("./"), F.substr(p, F.lit(3))).otherwise(p)


def lookup_path(ws: DataFrame, requests: DataFrame, keys: list[str], sudo: bool = False) -> DataFrame:
    """JOIN-7: resolve path requests against a flat workspace.

    A request is rejected when it is empty, ``.`` or contains ``..``; it resolves when the
    path exists, every ancestor is a folder and — unless ``sudo`` — no ancestor is hidden
    (a hidden file itself is still returned). Returns the requests with ``found`` and the
    matched file's columns.
    """
    req = requests.withColumn("rel", normalize_request(F.col("request")))
    bad_name = (F.col("request") == "") | (F.col("request") == ".") | F.col("request").contains("..")
    req = req.withColumn("bad_name", bad_name)
    # judged once per distinct parent folder: requests of one folder share its ancestors
    parent = F.array_join(F.slice(F.split("rel", "/"), 1, F.size(F.split("rel", "/")) - 1), "/")
    req = req.withColumn("parent", parent)
    anc = (req.select(*keys, "parent").distinct().filter(F.col("parent") != "")
           .select(*keys, "parent", F.explode(F.array_append(ancestors(F.col("parent")), F.col("parent"))).alias("path")))
    blocked = ~F.col("is_dir") | (F.lit(not sudo) & F.col("is_hidden"))
    bad_anc = (anc.join(ws.select(*keys, "path", "is_dir", "is_hidden"), [*keys, "path"], "left")
               .filter(F.col("is_dir").isNull() | blocked)
               .select(*keys, "parent").distinct())
    hit = req.join(ws.withColumnRenamed("path", "rel"), [*keys, "rel"], "left")
    ok = hit.join(bad_anc.withColumn("_bad", F.lit(True)), [*keys, "parent"], "left")
    found = ~F.col("bad_name") & F.col("name").isNotNull() & F.col("_bad").isNull()
    return ok.select(*keys, "request_id", "request", found.alias("found"),
                     F.when(found, F.col("rel")).alias("path"),
                     F.when(found, F.col("is_dir")).alias("is_dir"),
                     F.when(found, F.col("contents")).alias("contents"))


def _parent(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def apply_file_edits(ws: DataFrame, edits: DataFrame, keys: list[str], sudo: bool = False) -> tuple[DataFrame, DataFrame]:
    """JOIN-8: apply ``write`` / ``mkdir`` / ``remove`` edits in ``seq`` order (unique); returns (new
    workspace, one outcome per edit).

    A write makes or replaces a file, a mkdir makes a folder (or finds it there): both need a parent
    that is a folder at that time (the root always is) and a target that is not of the other kind.
    A remove needs an existing target and takes a folder's subtree; what it took can be made anew.
    Hidden or immutable files and folders of the input refuse unless ``sudo``, for as long as they are there.

    Folders live in intervals. Going down one depth at a time, a folder's intervals (``starts`` and
    ``ends``) say for each edit below it whether the parent is there and how many times everything
    below was taken before; between two such times the edits of one path decide in order: what is
    there is what the first write or mkdir since the last remove made. Of these edits follow the
    intervals of the folders one depth further down. Each depth is checkpointed.
    """
    from lectern.session import checkpoint_dir
    checkpoint_dir(ws.sparkSession)
    depth = F.size(F.split("path", "/"))
    guard = F.lit(not sudo) & (F.col("is_hidden") | F.col("is_immutable"))
    given = ws.select(*keys, "path", depth.alias("depth"), F.when(F.col("is_dir"), "mkdir").otherwise("write").alias("made"), guard.alias("guard"))
    edits = edits.select(*keys, "path", "seq", "op", "contents", depth.alias("depth"), _parent(F.col("path")).alias("parent"))
    deepest = max(df.agg(F.max("depth")).first()[0] or 0 for df in (given.filter(F.col("made") == "mkdir"), edits))
    none = F.array().cast("array<bigint>")
    lives, levels, folders = None, [], []
    for d in range(1, deepest + 1):
        here = edits.filter(F.col("depth") == d)
        mine = given.filter(F.col("depth") == d)
        dirs = mine.filter(F.col("made") == "mkdir").withColumn("parent", _parent(F.col("path")))
        if lives is None:  # below the root
            here = here.withColumns({"starts": none, "ends": none, "given": F.lit(True)})
            dirs = dirs.withColumn("ends", none)
        else:
            above = lives.withColumnRenamed("path", "parent")
            here = here.join(above, [*keys, "parent"], "left")
            dirs = dirs.join(above.select(*keys, "parent", "ends"), [*keys, "parent"], "left")
        here = here.join(mine.select(*keys, "path", "made", "guard"), [*keys, "path"], "left")
        done = _edit_level(here, keys, none).checkpoint()
        # intervals: of the folders given, and of those made
        first_remove = (done.filter(F.col("first_life") & (F.col("op") == "remove") & (F.col("status") == APPLIED))
                        .select(*keys, "path", F.col("seq").alias("removed")))
        old = (dirs.join(first_remove, [*keys, "path"], "left")
               .select(*keys, "path", F.lit(None).cast("bigint").alias("start"), F.least(F.array_min("ends"), "removed").alias("end")))
        made = done.filter(F.col("makes") & (F.col("op") == "mkdir"))
        after = F.array_min(F.filter("ends", lambda x: x > F.col("seq")))
        new = made.select(*keys, "path", F.col("seq").alias("start"), F.least(after, "removed").alias("end"))
        spans = old.unionByName(new)
        lives = (spans.groupBy(*keys, "path").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"),
                                                  F.max(F.col("start").isNull()).alias("given")).checkpoint())
        levels.append(done)
        folders.append(lives)
    if not levels:
        return ws, edits.select(*keys, "path", "op", "seq", F.lit(APPLIED).alias("status")).limit(0)
    done, lives = (reduce(DataFrame.unionByName, parts) for parts in (levels, folders))
    outcomes = done.select(*keys, "path", "op", "seq", "status")

    # the input's rows that are still there: not taken with their folder, not removed
    taken = lives.filter(F.col("given") & (F.size("ends") > 0)).select(*keys, "path")
    removed = (done.filter(F.col("first_life") & (F.col("op") == "remove") & (F.col("status") == APPLIED)).select(*keys, "path"))
    stay = (ws.withColumn("parent", _parent(F.col("path")))
            .join(taken.withColumnRenamed("path", "parent"), [*keys, "parent"], "left_anti").drop("parent")
            .join(taken, [*keys, "path"], "left_anti").join(removed, [*keys, "path"], "left_anti"))
    # what the last life of a path left, if neither a remove nor a taken folder ended it
    applied = done.filter((F.col("status") == APPLIED) & (F.col("op") != "remove") & F.col("removed").isNull() & (F.col("kills") == F.size("ends")))
    last = applied.groupBy(*keys, "path").agg(F.max_by(F.struct("op", "contents"), "seq").alias("e"), F.max("first_life").alias("first_life"))
    last = last.select(*keys, "path", F.col("e.op").alias("op"), F.col("e.contents").alias("new_contents"), "first_life")
    updated = (stay.join(last.filter("first_life").drop("first_life"), [*keys, "path"], "left")
               .withColumn("contents", F.when(F.col("op") == "write", F.col("new_contents")).otherwise(F.col("contents"))).drop("op", "new_contents"))
    created = last.filter(~F.col("first_life")).select(
        *keys, "path", F.element_at(F.split("path", "/"), -1).alias("name"), (F.col("op") == "mkdir").alias("is_dir"), F.lit(False).alias("is_tmpl"),
        F.lit(False).alias("is_immutable"), F.lit(False).alias("is_hidden"), F.when(F.col("op") == "write", F.col("new_contents")).alias("contents"))
    return updated.unionByName(created, allowMissingColumns=True), outcomes


#: Fixed value: the outcome of an edit that was done.
APPLIED = "applied"


def _edit_level(here: DataFrame, keys: list[str], none: Column) -> DataFrame:
    """The edits of one depth with their ``status``. ``kills``: how often the parent was taken before;
    ``first_life``: the input's row of the path is what the edit meets; ``makes``: it makes something;
    ``removed``: when the life it belongs to is removed."""
    here = here.withColumns({"starts": F.coalesce("starts", none), "ends": F.coalesce("ends", none), "given": F.coalesce("given", F.lit(False))})
    before = lambda times: F.size(F.filter(times, lambda x: x < F.col("seq")))
    here = here.withColumn("kills", before("ends"))
    here = here.withColumn("parent_ok", F.col("given").cast("int") + before("starts") > F.col("kills"))
    there = F.col("made").isNotNull() & (F.col("kills") == 0)  # the input's row, unless it was removed
    here = here.withColumn("guarded", F.col("parent_ok") & there & F.col("guard"))
    # the edits that can do something: lives of the path end with a taken folder or a remove
    life = Window.partitionBy(*keys, "path", "counts", "kills").orderBy("seq")
    here = here.withColumn("counts", F.col("parent_ok") & ~F.col("guarded"))
    here = here.withColumn("removes", F.coalesce(F.sum((F.col("op") == "remove").cast("int")).over(life.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    one = Window.partitionBy(*keys, "path", "counts", "kills", "removes")
    here = here.withColumn("first_life", F.col("counts") & there & (F.col("removes") == 0))
    here = here.withColumn("first_op", F.first("op").over(one.orderBy("seq")))
    here = here.withColumn("nth", F.row_number().over(one.orderBy("seq")))
    here = here.withColumn("removed", F.max(F.when(F.col("op") == "remove", F.col("seq"))).over(one))
    kind = F.when(F.col("first_life"), F.col("made")).when(F.col("nth") > 1, F.col("first_op"))
    status = (F.when(F.col("guarded"), F.lit("refused: protected file"))
              .when(~F.col("parent_ok") & (F.col("op") != "remove"), F.lit("refused: parent is not a folder"))
              .when(~F.col("parent_ok") | ((F.col("op") == "remove") & F.col("kind").isNull()), F.lit("refused: no such file"))
              .when((F.col("op") == "write") & (F.col("kind") == "mkdir"), F.lit("refused: target is a folder"))
              .when((F.col("op") == "mkdir") & (F.col("kind") == "write"), F.lit("refused: target is a file"))
              .otherwise(F.lit(APPLIED)))
    here = here.withColumn("kind", kind).withColumn("status", status)
    makes = F.col("counts") & F.col("kind").isNull() & (F.col("op") != "remove")
    return here.select(*keys, "path", "seq", "op", "contents", "status", "ends", "kills", "first_life", makes.alias("makes"),
                       F.when(F.col("counts"), F.col("removed")).alias("removed"))


def file_violations(ws: DataFrame, keys: list[str]) -> DataFrame:
    """VAL-10: bad names, files with children, too-deep trees, hidden files that would be
    serialised."""
    name = F.col("name")
    bad_name = (name == "") | (name == ".") | name.contains("..")
    bad_file_name = ~F.col("is_dir") & (name.contains("/") | name.contains(":"))
    too_deep = F.size(F.split("path", "/")) > MAX_DEPTH + 1
    # a non-folder with children: some row's parent path is this file's path
    parents = ws.select(*keys, F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
                        .alias("path")).distinct()
    has_children = parents.join(ws.filter(~F.col("is_dir")).select(*keys, "path"), [*keys, "path"])
    base = ws.select(*keys, "path", F.when(bad_name, F.lit("invalid file name"))
                     .when(bad_file_name, F.lit("invalid file name"))
                     .when(too_deep, F.lit("workspace file structure is too deep"))
                     .when(F.col("is_hidden"), F.lit("cannot serialise a hidden file")).alias("message"))
    return (base.filter(F.col("message").isNotNull())
            .unionByName(has_children.select(*keys, "path", F.lit("non-folder with children").alias("message"))))
