"""JOB-1 / JOB-2 / JOB-3: the entry jobs as compositions of the operators.

* ``convert``  read a catalogue in one layout (``folder`` or ``xml``), optionally stamp
               commit times, write it as ``folder``, ``xml`` or ``book`` rows.
* ``load``     catalogue → commit times → record sets → versioned upserts in the
               reference's order (question, versioned content, exam, course) + search
               index. Courses with violations are skipped unless ``force`` (the reference
               stops at the first bad course; here only the affected courses stay out).
* ``verify``   the violation table (read only).
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.ids import keyed
from lectern.functions.markup import html_to_markdown
from lectern.operators.hierarchy import Hierarchy, build_hierarchy
from lectern.operators.records import CourseRecords
from lectern.operators.timestamps import rollup_updated_at
from lectern.operators.validate import violations
from lectern.operators.xml_import import editor_files, import_xml
from lectern.sinks.export import book_rows, export_tree, export_xml
from lectern.sinks.upsert import UPSERT_ORDER, upsert_table
from lectern.sources.tree import with_path_parts


INDEX_BASE = "search_documents"


def hierarchy_from_xml(files: DataFrame, stage=None) -> Hierarchy:
    """SRC-3 + JOIN-2 + PRJ-27: an XML catalogue as folder-layout level tables. Problems
    keep their Markdown, html blocks are converted to Markdown, editor blocks become repl
    settings with their source files (PRJ-26); other block types stay (and are reported by
    VAL-5). Each table is made when it is first read; ``stage(name, df)`` may persist the blocks."""
    keep = stage or (lambda name, df: df)
    x = import_xml(files, stage)
    src = F.concat("url_name", F.lit(".repl/src"))

    def courses():
        attr = lambda name, default: F.coalesce(F.col("attrs")[name], F.lit(default))
        return x.courses.select(
            "course_id", F.lit(True).alias("has_index"), F.lit(None).cast("string").alias("parse_error"), "url_name",
            "display_name", "org", "course_code", "course_image", "language",
            attr("headline", "").alias("headline"), attr("description", "").alias("description"),
            F.split(attr("topics", ""), ",").alias("topics"), attr("primary_topic", "").alias("primary_topic"),
            attr("skill_level", "").alias("skill_level"), attr("info_md", "").alias("info_md"), attr("repo_url", "").alias("repo_url"),
            attr("weight", "0").alias("weight_raw"), attr("est_minutes", "0").alias("est_minutes_raw"),
            F.col("attrs")["instructor_timekit"].alias("instructor_timekit"))

    def chapters():
        return x.chapters.select("course_id", F.col("chapter_id").alias("folder"), "chapter_id", "idx",
                                 "display_name", F.col("chapter_id").alias("dir_name"))

    def seqs():
        return x.sequentials.select("course_id", F.col("seq_id").alias("folder"), "chapter_id", "seq_id", "idx",
                                    "display_name", "graded", "format", F.col("seq_id").alias("dir_name"))

    def verts():
        return x.verticals.select("course_id", F.col("vert_id").alias("folder"), "chapter_id", "seq_id", "vert_id",
                                  "idx", "display_name", F.col("vert_id").alias("dir_name"))

    @lru_cache(maxsize=None)
    def given():
        return keep("xml_blocks", x.blocks)

    @lru_cache(maxsize=None)
    def sources():
        return keep("xml_editor_files", editor_files(given()))

    def blocks():
        key = ["course_id", "vert_id", "block_idx"]
        repls = keyed(sources(), key).groupBy("_key", *key, "url_name", "environment", "api_version", "height").agg(
            F.count("path").alias("n")).select("_key", *key, F.to_json(F.struct(
                "api_version", "environment", F.when(F.col("n") > 0, src).otherwise(F.lit("")).alias("src_path"),
                F.struct("height").alias("display"))).alias("repl"))
        kind = F.col("block_type")
        content = (F.when(kind == "problem", F.coalesce("markdown", F.lit("")))
                   .when(kind == "html", html_to_markdown(F.when(kind == "html", F.coalesce("html", F.lit("")))))
                   .otherwise(F.coalesce("repl", F.lit(""))))
        return keep("xml_block_rows", keyed(given(), key).join(repls, ["_key", *key], "left").select(
            "course_id", "chapter_id", "seq_id", "vert_id", F.col("vert_id").alias("folder"),
            F.col("url_name").alias("path"), F.col("url_name").alias("name"), "block_idx", "block_type",
            "display_name", F.coalesce(F.col("attrs")["fs_path"], F.lit("")).alias("fs_path"), content.alias("content")))

    def folders():
        """Every level as folder rows, so that a missing title is reported (VAL-11)."""
        parts = [level.select("course_id", "folder", F.lit(depth).alias("level"), "dir_name", F.lit(True).alias("name_ok"),
                              F.when(F.col("display_name") != "", F.col("display_name")).alias("display_name"),
                              F.lit(None).cast("string").alias("parse_error"), F.lit("").alias("index_file"))
                 for depth, level in enumerate((h.chapters, h.sequentials, h.verticals), 1)]
        return reduce(DataFrame.unionByName, parts)

    def held():
        return with_path_parts(sources().filter(F.col("path").isNotNull()).select(
            "course_id", F.concat_ws("/", "vert_id", src, "path").alias("path"), F.col("contents").alias("content")))

    h = Hierarchy(courses=courses, chapters=chapters, sequentials=seqs, verticals=verts, blocks=blocks, folders=folders,
                  files=held, unparsed=lambda: x.errors.select("course_id", "path"))
    return h


def read_catalogue(files: DataFrame, fmt: str, stage=None) -> Hierarchy:
    if fmt == "folder":
        return build_hierarchy(files)
    if fmt == "xml":
        return hierarchy_from_xml(files, stage)
    raise ValueError(f"unsupported catalogue format: {fmt}")


def convert(files: DataFrame, from_fmt: str, to_fmt: str, stage=None) -> DataFrame:
    """JOB-1: catalogue rows in ``from_fmt`` → rows of ``to_fmt`` (``course_id, path, content``
    for layouts; ordered book rows for ``book``)."""
    h = read_catalogue(files, from_fmt, stage)
    if to_fmt == "folder":
        return export_tree(h, CourseRecords(h, stage=stage).editors)
    if to_fmt == "xml":
        return export_xml(h, CourseRecords(h, stage=stage).editors)
    if to_fmt == "book":
        return book_rows(h)
    raise ValueError(f"unsupported target format: {to_fmt}")


def verify(files: DataFrame, fmt: str = "folder", stage=None) -> DataFrame:
    """JOB-3: every violation of every course; XML documents that cannot be parsed are reported as
    VAL-13 from the pass that read them (what hangs below them is not read)."""
    return violations(CourseRecords(read_catalogue(files, fmt, stage), stage=stage))


def load(spark: SparkSession, h: Hierarchy, commits: DataFrame | None, out_base: str,
         force: bool = False, stage_dir: str = "_stage") -> DataFrame:
    """JOB-2: record sets of the valid courses (all with ``force``) upserted by id under
    ``out_base``: questions with their choices and code data, contents, exams, courses with their
    units, sections and cards, and one search index per language. Returns a per-course report.
    Parsed intermediates are staged under ``out_base/<stage_dir>`` and the report (one row per
    course) is checkpointed, so each record set is computed once."""
    from lectern.plans.stage import Stager
    stage = Stager(spark, f"{out_base}/{stage_dir}")
    updated = rollup_updated_at(h, commits, stage) if commits is not None else None
    r = CourseRecords(h, updated, stage=stage)
    bad = violations(r).groupBy("course_id").agg(F.count("*").alias("n_errors"))
    ok = h.courses.select("course_id", "language").join(bad, "course_id", "left").fillna({"n_errors": 0}).checkpoint(eager=True)
    take = ok if force else ok.filter(F.col("n_errors") == 0)
    keep = take.select("course_id")
    code = r.code_data.select("course_id", "vert_id", "block_idx", F.to_json("code").alias("code_data"))
    sets = {
        "question": r.questions.withColumn("choices", F.to_json("choices"))
        .join(code, ["course_id", "vert_id", "block_idx"], "left"),
        "versioned_content": r.versioned_contents,
        "exam": r.exams,
        "course": r.nested_courses,
    }
    now = F.current_timestamp()
    for name in UPSERT_ORDER:
        df = sets[name].join(keep, "course_id", "left_semi")
        key = ["course_id", "url_name" if name == "course" else "id"]
        stamp = {"static_data_updated_at": now, "updated_at": now} if name == "course" else None
        upsert_table(spark, f"{out_base}/{name}", df, key, stamp=stamp)
    # one index per language of the loaded courses
    docs = stage("search_documents", r.search_documents.join(keep, "course_id", "left_semi"))
    for row in take.select("language").distinct().collect():
        upsert_table(spark, f"{out_base}/{INDEX_BASE}_{row.language or ''}",
                     docs.filter(F.col("language").eqNullSafe(F.lit(row.language))), ["course_id", "id"])
    return ok.drop("language").withColumn("loaded", F.lit(force) | (F.col("n_errors") == 0))
