"""AGG-4 / AGG-6 / SET-4 / PRJ-12: what a card shows.

Per card (vertical), blocks in order:
* html block     → its Markdown + blank line; also the card's search text (no separator)
                   and the card's edit URL (the last html block wins);
* editor block   → the embedded editor iframe of its source workspace + blank line, and
                   its raw source text goes to the card's search code;
* JS editor block→ the JavaScript pane document + blank line;
* problem block  → nothing here (it becomes a question).

Ordered concatenation is an ordered ``listagg`` per card: one shuffle on the card key, and
each group is bounded by one card's blocks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.ids import join_keyed, keyed
from lectern.functions.text import url_path_segment_escape
from lectern.operators.workspace import attach_files, embed_editor, embed_frame, parse_repls, repl_roles, workspace_json

BLOCK_KEYS = ["course_id", "vert_id", "block_idx"]
CARD_KEYS = ["course_id", "vert_id"]
JS_ENV = "javascript_default_free"


def card_edit_url(repo_url: Column, fs_path: Column) -> Column:
    """PRJ-12: ``https://github.com`` + repo path + ``/edit/master/`` + escaped path parts;
    '' for any other host."""
    host = F.try_parse_url(repo_url, F.lit("HOST"))
    path = F.coalesce(F.try_parse_url(repo_url, F.lit("PATH")), F.lit(""))
    parts = F.array_join(F.transform(F.split(fs_path, "/"), lambda p: url_path_segment_escape(p)), "/")
    joined = F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/edit/master/"), parts)
    cleaned = F.regexp_replace(joined, "/{2,}", "/")
    return F.when(host == "github.com", F.concat(F.lit("https://github.com"), cleaned)).otherwise(F.lit(""))


class Editors:
    """Editor blocks with parsed repl settings and their flat workspaces."""

    def __init__(self, blocks: DataFrame, files: DataFrame, stage=None):
        keep = stage or (lambda name, df: df)
        ed = blocks.filter(F.col("block_type") == "exleditor")
        self.repls = keep("editor_repls", parse_repls(ed))
        self.roles = repl_roles(self.repls, BLOCK_KEYS)
        self.ws = attach_files(self.roles, files, BLOCK_KEYS, stage=stage, name="editor_workspace_files")
        self._keep = keep

    @cached_property
    def sources(self) -> DataFrame:
        """The source workspace of each editor: its JSON document, its text and its JavaScript."""
        return self._keep("editor_sources", workspace_json(
            self.ws.filter(F.col("role") == "src"), BLOCK_KEYS, names=self.repls, name_col="display_name")
            .select(*BLOCK_KEYS, "workspace_json", "source_text", "js_code"))

    def rendered(self) -> DataFrame:
        """Per editor block: ``piece`` (iframe or JS pane) and ``code`` (raw source, non-JS)."""
        r = join_keyed(self.repls.select(*BLOCK_KEYS, F.col("repl.environment").alias("environment")),
                       self.sources, BLOCK_KEYS, "left")
        js = F.col("environment") == JS_ENV
        return r.select(*BLOCK_KEYS,
                        F.when(js, embed_editor(F.col("js_code"))).otherwise(embed_frame(F.col("workspace_json")))
                        .alias("piece"),
                        F.when(js, F.lit(None)).otherwise(F.coalesce("source_text", F.lit(""))).alias("code"))


def card_content(blocks: DataFrame, editors: Editors, courses: DataFrame) -> DataFrame:
    """AGG-4 + AGG-6: per card ``content``, ``text``, ``code`` and ``edit_url`` (with the card's ``_key``)."""
    html = (blocks.filter(F.col("block_type") == "html")
            .join(courses.select("course_id", "repo_url"), "course_id", "left")
            .select(*BLOCK_KEYS, F.col("content").alias("piece"), F.col("content").alias("text"),
                    F.lit(None).cast("string").alias("code"),
                    F.when(F.coalesce("repo_url", F.lit("")) != "",
                           card_edit_url(F.col("repo_url"), F.col("fs_path"))).otherwise(F.lit("")).alias("edit_url")))
    ed = editors.rendered().select(*BLOCK_KEYS, "piece", F.lit(None).cast("string").alias("text"), "code",
                                   F.lit(None).cast("string").alias("edit_url"))
    pieces = html.unionByName(ed)
    return (keyed(pieces, CARD_KEYS).groupBy("_key", *CARD_KEYS).agg(
        F.expr("listagg(concat(piece, '\\n\\n'), '') WITHIN GROUP (ORDER BY block_idx)").alias("content"),
        F.expr("listagg(text, '') WITHIN GROUP (ORDER BY block_idx)").alias("text"),
        F.expr("listagg(code, '') WITHIN GROUP (ORDER BY block_idx)").alias("code"),
        F.max_by("edit_url", F.when(F.col("edit_url").isNotNull(), F.col("block_idx"))).alias("edit_url")))
