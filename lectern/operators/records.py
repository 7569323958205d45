"""Record sets of a catalogue: courses, units, sections, cards, versioned contents, exams,
questions and search documents (PRJ-8 … PRJ-16, AGG-2/3/7/9, SET-1/2/4, JOIN-3/9, FLT-3,
WIN-2/3).

``CourseRecords`` wires the operators once per catalogue; every attribute is a lazy
DataFrame. Ids in the records are the url names read from the index files.

Plan notes: the per-card and per-section tables are built with one shuffle each on their
key; nested course documents (AGG-7) gather only ids, titles and indexes — card content
stays in the versioned-content table, referenced by id.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.ids import join_keyed, keyed
from lectern.functions.paths import repl_ref
from lectern.functions.text import global_id, headline, question_time, topics_array, topics_csv
from lectern.operators.content import BLOCK_KEYS, CARD_KEYS, Editors, card_content
from lectern.operators.hierarchy import Hierarchy
from lectern.operators.ordinal import ordinal
from lectern.operators.problems import ParsedProblems, question_choices
from lectern.operators.workspace import ROLES, attach_files, embed_frame, parse_repls, repl_roles, workspace_json

# Fixed values used by the record sets.
EXAM_FORMAT_PREFIX = "Final Exam"
EXAM_PASS_PCT = 75
EXAM_CREATOR = "1ejFaqz00nJy"
UNIT_ATTEMPTS_PER_DAY = 2
DEFAULT_EST_MINUTES = 600
SUBSCRIPTION_LEVEL = 1
CERT_COST = 30
#: So many endings of named repl files are looked for by name, else all files are.
MAX_ENDINGS = 1000
SUPPORTED_KINDS = ["multiplechoiceresponse", "choiceresponse", "stringresponse"]

TIMEKIT_SCHEMA = T.StructType([T.StructField("intervals", T.ArrayType(T.StructType([
    T.StructField("credits", T.LongType()), T.StructField("project_id", T.StringType()),
    T.StructField("duration_seconds", T.LongType())])))])


def is_exam(graded: Column, fmt: Column) -> Column:
    """FLT-3: graded and the format starts with ``Final Exam``."""
    return graded & fmt.startswith(EXAM_FORMAT_PREFIX)


def round_half_up_minutes(seconds: Column, factor: float = 1.0) -> Column:
    """``round(seconds * factor / 60)`` with halves rounded up, as an int."""
    return F.floor(seconds.cast("double") * F.lit(factor) / F.lit(60.0) + F.lit(0.5)).cast("int")


def course_defaults(courses: DataFrame) -> DataFrame:
    """PRJ-8 / PRJ-9 / PRJ-10: the typed course record fields with the reference's defaults."""
    int_re = r"^[+-]?[0-9]+$"
    sk = F.col("skill_level")
    return courses.select(
        "course_id", "url_name", "display_name", "language", "headline", "description", "info_md",
        "primary_topic", "repo_url", "course_image", "org", "course_code",
        F.when(F.col("est_minutes_raw").rlike(int_re), F.col("est_minutes_raw").try_cast("int"))
        .otherwise(F.lit(DEFAULT_EST_MINUTES)).alias("est_minutes"),
        F.when(F.col("weight_raw").rlike(int_re), F.col("weight_raw").try_cast("int")).otherwise(F.lit(0)).alias("weight"),
        F.when(sk == "", F.lit(1)).when(sk.rlike(int_re), sk.try_cast("int")).alias("skill_level"),
        topics_array(topics_csv(F.col("topics"))).alias("topics"),
        F.coalesce(F.from_json(F.col("instructor_timekit"), TIMEKIT_SCHEMA),
                   F.struct(F.array().cast(TIMEKIT_SCHEMA["intervals"].dataType).alias("intervals")))
        .alias("instructor_timekit"),
        F.lit(SUBSCRIPTION_LEVEL).alias("subscription_level"), F.lit(CERT_COST).alias("verified_cert_cost"),
        F.lit(True).alias("is_published"), F.lit(False).alias("is_organization_only"),
        F.lit(0).alias("view_count"), F.lit(0).alias("enrolled_count"),
        F.col("course_image").alias("cover_url"), F.col("course_image").alias("logo_url"),
    )


def course_attrs(courses: DataFrame) -> DataFrame:
    """PRJ-30: the typed course fields as a string map (the attribute set written to other
    layouts): info_md, description, headline, topics (CSV), primary_topic, repo_url,
    instructor_timekit (compact JSON, ``null`` when absent), est_minutes, weight."""
    tk = F.to_json(F.from_json(F.col("instructor_timekit"), TIMEKIT_SCHEMA))
    return courses.select("course_id", F.create_map(
        F.lit("info_md"), F.col("info_md"), F.lit("description"), F.col("description"),
        F.lit("headline"), F.col("headline"), F.lit("topics"), topics_csv(F.col("topics")),
        F.lit("primary_topic"), F.col("primary_topic"), F.lit("repo_url"), F.col("repo_url"),
        F.lit("instructor_timekit"), F.coalesce(tk, F.lit("null")),
        F.lit("est_minutes"), F.col("est_minutes_raw"), F.lit("weight"), F.col("weight_raw")).alias("attrs"))


class CourseRecords:
    def __init__(self, h: Hierarchy, updated=None, stage=None):
        """``updated``: the rolled-up times by level, or a function that gives them (called when a
        record set with times is read). ``stage(name, df)`` may persist an intermediate and return
        the stored copy (see ``lectern.plans.stage``); by default everything stays lazy."""
        self.h = h
        self._rolled_up = updated
        self.stage = stage or (lambda name, df: df)

    # ------------------------------------------------------------------ building blocks

    @cached_property
    def updated(self) -> dict[str, DataFrame] | None:
        return self._rolled_up() if callable(self._rolled_up) else self._rolled_up

    @cached_property
    def editors(self) -> Editors:
        return Editors(self.h.blocks, self.h.files, self.stage)

    @cached_property
    def course_ids(self) -> DataFrame:
        """course_id → url name used in records."""
        return self.h.courses.select("course_id", F.col("url_name").alias("course_ref"))

    @cached_property
    def seqs(self) -> DataFrame:
        """Sequentials with the exam flag (WIN-2: indexes were numbered before this filter)."""
        return self.h.sequentials.withColumn("is_exam", is_exam(F.col("graded"), F.col("format")))

    @cached_property
    def cards(self) -> DataFrame:
        """Verticals with their sequential's exam flag."""
        return self.h.verticals.join(self.seqs.select("course_id", "seq_id", "is_exam"), ["course_id", "seq_id"])

    @cached_property
    def problems(self) -> ParsedProblems:
        docs = self.h.blocks.filter(F.col("block_type") == "problem").select(*BLOCK_KEYS, F.col("content").alias("text"))
        return ParsedProblems(docs, BLOCK_KEYS, self.stage)

    @cached_property
    def problem_records(self) -> DataFrame:
        """TXT-13 per problem block, with WIN-3 question ids and the exam flag."""
        pb = self.h.blocks.filter(F.col("block_type") == "problem").select(*BLOCK_KEYS, "folder", "seq_id", "chapter_id")
        pb = ordinal(pb, ["course_id", "vert_id"], ["block_idx"], "q_rank")
        out = (keyed(pb, BLOCK_KEYS).join(self.problems.keyed_records(), ["_key", *BLOCK_KEYS], "left").drop("_key")
               .join(self.seqs.select("course_id", "seq_id", "is_exam"), ["course_id", "seq_id"]))
        qid = F.when(F.col("is_exam"), F.col("vert_id")).otherwise(
            F.concat(F.col("vert_id"), F.lit("_q_"), F.col("q_rank").cast("string")))
        return self.stage("problem_records", out.withColumn("question_id", qid))

    @cached_property
    def code_repls(self) -> DataFrame:
        """JOIN-3: string-response problems whose answer names a repl file in the same folder."""
        pr = self.problem_records.filter((F.col("kind") == "stringresponse") & F.col("answer").startswith("#!"))
        pr = pr.withColumn("repl_file", repl_ref(F.col("answer")))
        pr = pr.withColumn("repl_path", F.concat_ws("/", "folder", "repl_file"))
        # only files with the ending of a file that is named can be it (endings are few, or all files are taken)
        ending = lambda path: F.expr(f"substring(substring_index({path}, '/', -1), instr(substring_index({path}, '/', -1), '.'))")
        endings = [r[0] for r in pr.select(ending("repl_path")).distinct().limit(MAX_ENDINGS + 1).collect()]
        files = self.h.files if len(endings) > MAX_ENDINGS else self.h.files.filter(ending("path").isin(*endings))
        files = files.select("course_id", F.col("path").alias("repl_path"), "content")
        return self.stage("code_repls", join_keyed(pr, files, ["course_id", "repl_path"], "left"))

    @cached_property
    def code_data(self) -> DataFrame:
        """PRJ-25: code-question data (api version, environment, workspace JSONs, tests,
        grading strategy, explanation = text + blank line + iframe)."""
        j = self.code_repls.filter(F.col("content").isNotNull())
        repls = self.stage("code_question_repls", parse_repls(j.select(*BLOCK_KEYS, "folder", "content")))
        roles = repl_roles(repls, BLOCK_KEYS)
        ws = attach_files(roles, self.h.files, BLOCK_KEYS, stage=self.stage, name="code_question_files")
        of = lambda role, text: F.first(F.when(F.col("role") == role, F.col(text)), ignorenulls=True)
        files = keyed(workspace_json(ws, BLOCK_KEYS), BLOCK_KEYS).groupBy("_key", *BLOCK_KEYS).agg(
            *[of(role, "files_json").alias(role) for role in ROLES], of("src", "workspace_json").alias("src_ws"))
        r = keyed(repls, BLOCK_KEYS).join(files, ["_key", *BLOCK_KEYS], "left")
        expl = F.concat(F.when(F.col("repl.explanation") != "", F.concat(F.col("repl.explanation"), F.lit("\n\n")))
                        .otherwise(F.lit("")), embed_frame(F.col("src_ws")))
        tests = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.col("repl.tests")))))
        return r.select(*BLOCK_KEYS, F.struct(
            F.col("repl.api_version").alias("api_version"), F.col("repl.environment").alias("environment"),
            F.coalesce("src", F.lit("null")).alias("src_files"), F.coalesce("tmpl", F.lit("null")).alias("tmpl_files"),
            F.coalesce("test", F.lit("null")).alias("test_files"),
            F.col("repl.grading_strategy").alias("grading_strategy"),
            F.coalesce(tests, F.lit("null")).alias("grading_tests"),
            expl.alias("explanation")).alias("code"))

    # ------------------------------------------------------------------------- records

    @cached_property
    def contents(self) -> DataFrame:
        """AGG-4 per card (all cards; empty strings where a card has nothing to show)."""
        cc = card_content(self.h.blocks, self.editors, self.h.courses)
        cards = keyed(self.cards.select(*CARD_KEYS), CARD_KEYS)
        return self.stage("card_contents", cards.join(cc, ["_key", *CARD_KEYS], "left")
                          .select("course_id", "vert_id", *[F.coalesce(c, F.lit("")).alias(c)
                                                             for c in ("content", "text", "code", "edit_url")]))

    @cached_property
    def versioned_contents(self) -> DataFrame:
        """SET-4: one versioned content per (non-exam) card."""
        c = self.contents.join(self.cards.filter(~F.col("is_exam")).select("course_id", "vert_id"),
                               ["course_id", "vert_id"])
        return c.select("course_id", F.concat(F.col("vert_id"), F.lit("_vc")).alias("id"),
                        F.lit(1).alias("latest_version"), F.lit(1).alias("version"), "content")

    @cached_property
    def questions(self) -> DataFrame:
        """SET-2 + JOIN-9: card questions and exam questions (exam_only) of supported kinds."""
        pr = self.problem_records.filter(F.col("kind").isin(*SUPPORTED_KINDS))
        # exam questions only from valid exam cards: exactly one block, a problem (VAL-8)
        bad_exam = self.exam_blocks.filter((F.col("n_blocks") != 1) | (F.col("non_problem") != 0))
        pr = pr.join(bad_exam.select("course_id", "vert_id"), ["course_id", "vert_id"], "left_anti")
        pr = pr.join(self.course_ids, "course_id")
        refs = F.array(F.struct(F.col("course_ref").alias("doc_id"), F.lit("course").alias("level")),
                       F.struct(F.col("chapter_id").alias("doc_id"), F.lit("unit").alias("level")),
                       F.struct(F.col("seq_id").alias("doc_id"), F.lit("section").alias("level")))
        card_ref = F.array(F.struct(F.col("vert_id").alias("doc_id"), F.lit("card").alias("level")))
        return pr.select(
            "course_id", "vert_id", "block_idx", F.col("question_id").alias("id"), "question_type",
            F.col("label").alias("question_text"), question_time(F.col("question_type")).alias("est_time_sec"),
            F.coalesce("demand_hint", F.lit("")).alias("hint"),
            F.when(F.col("is_exam"), refs).otherwise(F.concat(refs, card_ref)).alias("doc_refs"),
            F.col("course_ref").alias("ref_course_id"), F.col("chapter_id").alias("ref_unit_id"),
            F.col("seq_id").alias("ref_section_id"),
            F.when(~F.col("is_exam"), F.col("vert_id")).alias("ref_card_id"),
            F.col("is_exam").alias("exam_only"), F.lit(1).alias("points"), F.lit(1).alias("complexity_level"),
            F.array().cast("array<string>").alias("tags"), "kind", "choices", "answer")

    @cached_property
    def question_choices(self) -> DataFrame:
        """TXT-14 for the catalogue's supported questions."""
        q = self.questions.select(*BLOCK_KEYS, "id", "choices")
        return question_choices(q, [*BLOCK_KEYS, "id"])

    @cached_property
    def card_question_ids(self) -> DataFrame:
        """AGG-9: ordered question ids per card."""
        q = self.questions.filter(~F.col("exam_only"))
        return q.groupBy("course_id", "vert_id").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "id"))), lambda x: x["id"]).alias("question_ids"))

    @cached_property
    def exam_blocks(self) -> DataFrame:
        """Per exam card: number of blocks and whether all are problems (VAL-8 input)."""
        ex = self.cards.filter(F.col("is_exam")).select("course_id", "seq_id", "vert_id", "idx")
        b = self.h.blocks.groupBy("course_id", "vert_id").agg(
            F.count("*").alias("n_blocks"), F.max((F.col("block_type") != "problem").cast("int")).alias("non_problem"))
        return ex.join(b, ["course_id", "vert_id"], "left").fillna({"n_blocks": 0, "non_problem": 0})

    @cached_property
    def exams(self) -> DataFrame:
        """AGG-2: per exam sequential, over its valid cards (one problem block of a
        supported kind): counts, rounded time sums, ordered question ids."""
        valid = self.exam_blocks.filter((F.col("n_blocks") == 1) & (F.col("non_problem") == 0))
        q = self.questions.filter(F.col("exam_only")).select("course_id", "vert_id", "est_time_sec")
        v = valid.join(q, ["course_id", "vert_id"])
        agg = v.groupBy("course_id", "seq_id").agg(
            F.count("*").alias("question_count"),
            F.sum(round_half_up_minutes(F.col("est_time_sec"))).alias("est_time"),
            F.sum(round_half_up_minutes(F.col("est_time_sec"), 1.5)).alias("time_limit"),
            F.transform(F.sort_array(F.collect_list(F.struct("idx", "vert_id"))), lambda x: x["vert_id"])
            .alias("question_ids"))
        ex = self.seqs.filter("is_exam").select("course_id", "chapter_id", "seq_id")
        return (ex.join(agg, ["course_id", "seq_id"], "left")
                .select("course_id", "chapter_id", "seq_id", F.concat(F.col("seq_id"), F.lit("_exam")).alias("id"),
                        F.coalesce("question_count", F.lit(0)).alias("question_count"),
                        F.coalesce("est_time", F.lit(0)).alias("est_time"),
                        F.coalesce("time_limit", F.lit(0)).alias("time_limit"),
                        F.coalesce("question_ids", F.array().cast("array<string>")).alias("question_ids"),
                        F.lit(EXAM_PASS_PCT).alias("pass_mark_pct"), F.lit(True).alias("use_ide_test_mode"),
                        F.lit(EXAM_CREATOR).alias("creator_id")))

    def _updated(self, level: str, key: list[str]) -> DataFrame | None:
        if self.updated is None:
            return None
        return self.updated[level].select(*key, "updated_at")

    @cached_property
    def card_records(self) -> DataFrame:
        """Card rows of non-exam sections (index = position + 1)."""
        c = (self.cards.filter(~F.col("is_exam"))
             .join(self.contents.select("course_id", "vert_id", "edit_url"), ["course_id", "vert_id"], "left")
             .join(self.card_question_ids, ["course_id", "vert_id"], "left")
             .join(self.course_ids, "course_id"))
        u = self._updated("vertical", ["course_id", "vert_id"])
        if u is not None:
            c = c.join(u, ["course_id", "vert_id"], "left")
        else:
            c = c.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
        return c.select("course_id", "chapter_id", "seq_id", F.col("vert_id").alias("id"),
                        (F.col("idx") + 1).alias("index"), F.col("display_name").alias("title"),
                        headline(F.col("display_name")).alias("headline"),
                        F.concat(F.col("vert_id"), F.lit("_vc")).alias("content_id"),
                        F.coalesce("question_ids", F.array().cast("array<string>")).alias("question_ids"),
                        F.coalesce("edit_url", F.lit("")).alias("github_edit_url"),
                        F.col("course_ref").alias("ref_course_id"), F.col("chapter_id").alias("ref_unit_id"),
                        F.col("seq_id").alias("ref_section_id"), F.col("vert_id").alias("ref_card_id"),
                        F.array().cast("array<string>").alias("tags"), "updated_at")

    @cached_property
    def section_records(self) -> DataFrame:
        s = self.seqs.filter(~F.col("is_exam"))
        u = self._updated("sequential", ["course_id", "seq_id"])
        s = s.join(u, ["course_id", "seq_id"], "left") if u is not None else s.withColumn(
            "updated_at", F.lit(None).cast("timestamp_ntz"))
        return s.select("course_id", "chapter_id", F.col("seq_id").alias("id"), (F.col("idx") + 1).alias("index"),
                        F.col("display_name").alias("title"), headline(F.col("display_name")).alias("headline"),
                        "updated_at")

    @cached_property
    def unit_records(self) -> DataFrame:
        """Units: index = position + 1; exam weight = 100 / number of chapters (AGG-3);
        final exam ids in section order."""
        n = F.count("*").over(Window.partitionBy("course_id"))
        ch = self.h.chapters.withColumn("n_chapters", n)
        fe = (self.seqs.filter("is_exam").groupBy("course_id", "chapter_id")
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "seq_id"))),
                               lambda x: F.concat(x["seq_id"], F.lit("_exam"))).alias("final_exam_ids")))
        u = self._updated("chapter", ["course_id", "chapter_id"])
        c = ch.join(fe, ["course_id", "chapter_id"], "left")
        c = c.join(u, ["course_id", "chapter_id"], "left") if u is not None else c.withColumn(
            "updated_at", F.lit(None).cast("timestamp_ntz"))
        return c.select("course_id", F.col("chapter_id").alias("id"), (F.col("idx") + 1).alias("index"),
                        F.col("display_name").alias("title"), headline(F.col("display_name")).alias("headline"),
                        (F.lit(100.0) / F.col("n_chapters")).alias("final_exam_weight_pct"),
                        F.lit(UNIT_ATTEMPTS_PER_DAY).alias("attempts_allowed_per_day"),
                        F.coalesce("final_exam_ids", F.array().cast("array<string>")).alias("final_exam_ids"),
                        "updated_at")

    @cached_property
    def course_records(self) -> DataFrame:
        c = course_defaults(self.h.courses)
        u = self._updated("course", ["course_id"])
        c = c.join(u, ["course_id"], "left") if u is not None else c.withColumn(
            "updated_at", F.lit(None).cast("timestamp_ntz"))
        return c.withColumnRenamed("updated_at", "content_updated_at")

    @cached_property
    def nested_courses(self) -> DataFrame:
        """AGG-7: course documents with units ⊃ sections ⊃ cards (ids, titles, indexes),
        each level ordered by index; exam sections appear as the unit's final exam ids."""
        card = self.card_records.groupBy("course_id", "seq_id").agg(F.sort_array(F.collect_list(F.struct(
            "index", "id", "title", "headline", "content_id", "question_ids", "github_edit_url"))).alias("cards"))
        sec = self.section_records.join(card.withColumnRenamed("seq_id", "id"), ["course_id", "id"], "left")
        sec = sec.groupBy("course_id", "chapter_id").agg(F.sort_array(F.collect_list(F.struct(
            "index", "id", "title", "headline", F.coalesce("cards", F.array()).alias("cards")))).alias("sections"))
        unit = (self.unit_records.join(sec.withColumnRenamed("chapter_id", "id"), ["course_id", "id"], "left")
                .groupBy("course_id").agg(F.sort_array(F.collect_list(F.struct(
                    "index", "id", "title", "headline", "final_exam_weight_pct", "attempts_allowed_per_day",
                    "final_exam_ids", F.coalesce("sections", F.array()).alias("sections")))).alias("units")))
        return self.course_records.join(unit, "course_id", "left")

    @cached_property
    def search_documents(self) -> DataFrame:
        """SET-1: card, section, unit and course search documents (exam sections and their
        cards yield none)."""
        cc = self.contents.select("course_id", "vert_id", "text", "code")
        cards = (self.card_records.join(cc.withColumnRenamed("vert_id", "id"), ["course_id", "id"], "left")
                 .select("course_id", global_id("Card", F.col("id")).alias("id"), F.lit("card").alias("doc_type"),
                         "title", "headline", F.col("text").alias("text_content"), F.col("code").alias("code_content"),
                         F.col("ref_course_id").alias("course_ref"), F.col("ref_unit_id").alias("unit_id"),
                         F.col("ref_section_id").alias("section_id"), F.col("ref_card_id").alias("card_id")))
        cref = self.course_ids
        secs = (self.section_records.join(cref, "course_id")
                .select("course_id", global_id("Section", F.col("id")).alias("id"), F.lit("section").alias("doc_type"),
                        "title", "headline", F.col("course_ref"), F.col("chapter_id").alias("unit_id"),
                        F.col("id").alias("section_id")))
        units = (self.unit_records.join(cref, "course_id")
                 .select("course_id", global_id("Unit", F.col("id")).alias("id"), F.lit("unit").alias("doc_type"),
                         "title", "headline", "course_ref", F.col("id").alias("unit_id")))
        courses = self.h.courses.select(
            "course_id", global_id("Course", F.col("url_name")).alias("id"), F.lit("course").alias("doc_type"),
            F.col("display_name").alias("title"), "headline", F.col("description").alias("text_content"),
            F.col("url_name").alias("course_ref"))
        return (cards.unionByName(secs, allowMissingColumns=True).unionByName(units, allowMissingColumns=True)
                .unionByName(courses, allowMissingColumns=True)
                .join(self.h.courses.select("course_id", "language"), "course_id", "left"))
